"""Names, codes and limits shared by all stages."""

from __future__ import annotations

# Quality-control codes and their texts.
QC_DEFAULT = 0
QC_VALID = 1
QC_NOT_ENOUGH_VALID_CELLS = 1001
QC_TOO_MANY_CELLS = 1002
QC_NOT_ENOUGH_BG_PIXELS = 1003
QC_OUT_OF_PERIPHERY = 2001
QC_TOO_SMALL_NUCLEUS = 2002
QC_TOO_BIG_NUCLEUS = 2003
QC_TOO_SMALL_CYTOPLASM = 2004
QC_TOO_BIG_CYTOPLASM = 2005
QC_TOO_SMALL_NUCLEUS_SOLIDITY = 2006

QC_TEXT = {
    0: "default",
    1: "valid",
    1001: "not enough valid cells",
    1002: "too many cells",
    1003: "not enough background pixels",
    2001: "out of image periphery",
    2002: "too small nucleus area",
    2003: "too big nucleus area",
    2004: "too small cytoplasm area",
    2005: "too big cytoplasm area",
    2006: "too small nucleus solidity",
}

# Largest model (centroids, covariance, scaling …) in doubles that may pass through the driver.
MAX_MODEL_VALUES = 20_000_000

# Distance expressions up to this many terms are unrolled into generated code;
# larger ones run as one matrix product per Arrow batch.
UNROLL_TERMS = 128


def check_model_size(values: int, what: str) -> None:
    if values > MAX_MODEL_VALUES:
        raise ValueError(f"{what} holds {values} values, more than a driver-side model may hold ({MAX_MODEL_VALUES})")
