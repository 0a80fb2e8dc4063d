"""One module per family of operators; importing it registers the queries."""

from volumetry.plans.queries import (  # noqa: F401
    augmentation, cohort, cohort_splits, history, intensity, morphology, pairs, quality, space, stats, storage,
)

FLAGSHIP = "qc_metrics"
