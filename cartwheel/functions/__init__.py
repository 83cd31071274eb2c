from cartwheel.functions.semantics import (  # noqa: F401
    DAY, MONTH, MONTH_START, flag, half_even, half_even_pct, money, month_name,
    period_key, ratio, to_double,
)
