from .bands import (
    BRANCH_BANDS, MATCH_BANDS, PRIORITY_BANDS, RESOLUTION_BANDS, band, clamp_percent, ordinal,
    urgency,
)
from .text import (
    blank_to_null, contains_any, ellipsis, ellipsis_if_longer, fill_template, hours_label,
    lookup, message_body, message_kind, padded_id, percent_text, prefix_key, short_date,
    short_timestamp,
)
from .time import (
    add_hours, format_minute, hours_between, month_of, parse_created, remaining_label,
)

__all__ = [n for n in dir() if not n.startswith("_")]
