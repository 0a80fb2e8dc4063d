"""Every registered query of the corpus operators: SQL where there is some, else brute force."""

import hashlib
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from volumetry.llm import packing, queries, simhash
from volumetry.llm.batches import PIECE_BYTES

TABLES = "documents pages benchmark labels conversations"


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(data):
    import pyarrow.parquet as pq

    return {r["doc_id"]: r for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = con.execute(queries.CHECKS[name]).df()
    got = queries.RUNS[name](spark, data).toPandas()[list(want.columns)]
    order = list(want.columns)
    left, right = (df.sort_values(order).astype(str).reset_index(drop=True) for df in (got, want))
    assert left.equals(right)


def test_op2(spark, data, docs):
    rows = queries.RUNS["op2_rules"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        tri = list(zip(w, w[1:], w[2:]))
        hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(tri) < 3000 else None
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), dup)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        if hit is not None:
            assert r.n_repeat_words == len(hit)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_op3(spark, data):
    import pyarrow.parquet as pq

    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{data}/pages.parquet").to_pylist()}
    rows = queries.RUNS["op3_markup"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(re.sub("&quot;", '"', re.sub("&amp;", "&", re.sub("<[^>]*>", "", p))).split()) for p in re.split(r"</?(?:p|br|h1)>", inside)]
        if not re.search(r"&(?!amp;|quot;)[a-z]+", inside):
            assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_op4(spark, data, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.word_vocabulary())
    for r in queries.RUNS["op4_bpe"](spark, data).collect():
        ids = whole.encode(docs[r.doc_id]["text"] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(whole.decode(ids, skip_special_tokens=False))


def test_op5(spark, data, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for r in queries.RUNS["op5_secrets"](spark, data).collect():
        text = docs[r.doc_id]["text"] or ""
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        assert r.base_sha256 == sha(base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[3] == k for f in found) for k in ("assign", "access", "hex")]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op7(spark, data, docs):
    rows = queries.RUNS["op7_langid"](spark, data).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id]["lang"] for r in held]) > 0.9


def test_op8(spark, data, docs):
    rows = queries.RUNS["op8_simhash"](spark, data).collect()
    ids = sorted(docs)
    prints = {i: simhash.fingerprint((docs[i]["text"] or "").encode()) & (2**64 - 1) for i in ids}
    for i in ids[:60]:  # the definition, bit by bit
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(docs[i]["text"] or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        assert prints[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{prints[i]:016x}", root(i)) for i in ids}


def test_op9(spark, data, docs):
    rows = {r.doc_id: r for r in queries.RUNS["op9_maxent"](spark, data).collect()}
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(d["text"] or "")), None] for i, d in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = {}
    for i in set(docs) - held:
        for w in words[i]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in rows.items():
        c = [counts.get(w, 0) for w in words[i]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(c), sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(sum(np.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), rel=1e-9)
    out = [rows[i] for i in held]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op10(spark, data, docs):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as f:
        use = packing.encoder(f.read(), public_tokenizers.PATTERN)
    whole = {i: use.encode_ordinary(d["text"] or "") for i, d in docs.items()}
    assert all(use.decode(ids) == (docs[i]["text"] or "") for i, ids in whole.items())
    parts, rows = {}, queries.RUNS["op10_pack"](spark, data).collect()
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == r.n_tokens <= 2048 and r.cu_seqlens[-1] == r.n_tokens and len(r.doc_ids) == r.n_segments
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault(r.doc_ids[k], {})[r.starts[k]] = ids[a:b].tolist()
    assert {d: [x for at in sorted(p) for x in p[at]] for d, p in parts.items()} == {d: i for d, i in whole.items() if i}
    assert sum(r.n_tokens for r in rows) > 0.95 * 2048 * (len(rows) - 1)
    assert PIECE_BYTES > 0
