from cellgrove.functions.columns import chi2_tail, finite, fold, half_even, normal_tail, ratio, t_two_sided, tile, uniform

__all__ = ["chi2_tail", "finite", "fold", "half_even", "normal_tail", "ratio", "t_two_sided", "tile", "uniform"]
