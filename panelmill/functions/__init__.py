from panelmill.functions.columns import (  # noqa: F401
    clip,
    col,
    count_if,
    finite,
    month_end,
    month_index,
    nan_to_null,
    normal_cdf,
    normal_quantile,
    positive,
    ratio,
    rnd,
    two_sided_p,
    uniform,
)
from panelmill.functions.ranking import (  # noqa: F401
    avg_rank,
    group_stats,
    quantiles,
    row_rank,
    row_ranks,
)
from panelmill.functions.paired import (  # noqa: F401
    spearman,
    spearmans,
)
