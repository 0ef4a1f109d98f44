from cellgrove.plans.lineage import cut, few, kept, release
from cellgrove.plans.quantiles import quantiles
from cellgrove.plans.running import ranked, running_total

__all__ = ["cut", "few", "kept", "quantiles", "ranked", "release", "running_total"]
