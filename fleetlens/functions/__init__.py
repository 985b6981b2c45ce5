"""Column functions; each takes columns and returns a column."""

from fleetlens.functions.numbers import plain_text, round_half_up
from fleetlens.functions.paths import ancestors, join_path, parent_path, path_parts, resolve_path, segments
from fleetlens.functions.sizes import entry_size, format_bytes, format_mem
from fleetlens.functions.states import (
    allowed_action,
    app_state_class,
    badge_type,
    is_running,
    node_state,
    node_state_class,
    retry_text,
    workflow_state_label,
    workflow_state_tag,
)
from fleetlens.functions.texts import app_id, app_link, first_lines, is_numeric, remote_error
from fleetlens.functions.times import (
    age_text,
    epoch_millis,
    format_duration,
    format_elapsed,
    format_timestamp,
    utc_text,
)
from fleetlens.functions.usage import queue_quota, severity, severity_colour, utilisation

__all__ = [name for name in dir() if not name.startswith("_")]
