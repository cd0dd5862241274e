"""Column-level building blocks (pure Spark SQL expressions, codegen-friendly)."""

from spanloom.functions.spans import (  # noqa: F401
    found_in, locate0, overlaps, span_slice, validate_reason,
)
from spanloom.functions.mapping import (  # noqa: F401
    is_mapped, mapping_text, normalize_value,
)
