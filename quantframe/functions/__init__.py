from quantframe.functions.columns import finite_or_null, is_finite, missing_as_null, safe_corr
from quantframe.functions.costs import CostModel, CryptoCost, FxCost
from quantframe.functions.signals import threshold_signal, zscore_fixed

__all__ = [
    "CostModel", "CryptoCost", "FxCost", "finite_or_null", "is_finite", "missing_as_null",
    "safe_corr", "threshold_signal", "zscore_fixed",
]
