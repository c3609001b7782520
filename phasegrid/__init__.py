"""Two-dimensional phase unwrapping and grid analytics on Spark DataFrames."""

from phasegrid.functions.phase import effective_looks
from phasegrid.operators.components import regrow
from phasegrid.operators.costs import build_costs
from phasegrid.options import BridgeOptions, CostModel, LaplaceOptions, UnwrapOptions
from phasegrid.plans.unwrap import cluster_info, unwrap, unwrap_arrays

__version__ = "0.1.0"
__all__ = ["BridgeOptions", "CostModel", "LaplaceOptions", "UnwrapOptions", "build_costs", "cluster_info", "effective_looks", "regrow", "unwrap", "unwrap_arrays"]
