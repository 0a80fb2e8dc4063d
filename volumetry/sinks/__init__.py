"""Writers of volumes, metrics, splits and reports."""
