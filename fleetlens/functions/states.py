"""States as labels, classes and permitted actions."""

from itertools import chain

from pyspark.sql import Column, functions as F

from fleetlens import fixed


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A small constant table as one folded map literal: no join, no broadcast."""
    pairs = chain.from_iterable(table.items())
    return F.element_at(F.create_map(*[F.lit(x) for x in pairs]), key)


def app_state_class(state: Column) -> Column:
    return F.coalesce(_lookup(fixed.APP_STATE_CLASS, state), F.lit(fixed.DEFAULT_CLASS))


def badge_type(state_class: Column) -> Column:
    return F.coalesce(_lookup(fixed.BADGE_TYPE, state_class), F.lit(fixed.DEFAULT_BADGE))


def workflow_state_label(state: Column) -> Column:
    main = {code: label for code, (label, _) in fixed.WORKFLOW_STATES.items()}
    return F.coalesce(_lookup({**fixed.EXTRA_STATE_LABELS, **main}, state), state)


def workflow_state_tag(state: Column) -> Column:
    tags = {code: tag for code, (_, tag) in fixed.WORKFLOW_STATES.items()}
    return F.coalesce(_lookup(tags, state), F.lit(fixed.DEFAULT_TAG))


def is_running(state: Column) -> Column:
    return F.coalesce(state.isin(fixed.RUNNING_WORKFLOW_STATES), F.lit(False))


def allowed_action(state: Column) -> Column:
    return F.when(is_running(state), fixed.RUNNING_ACTIONS).otherwise(fixed.IDLE_ACTION)


def node_state(admin_state: Column) -> Column:
    return F.coalesce(admin_state, F.lit(fixed.DEFAULT_NODE_STATE))


def node_state_class(admin_state: Column) -> Column:
    return F.when(node_state(admin_state) == fixed.DEFAULT_NODE_STATE, "success").otherwise("warning")


def retry_text(tries: Column, most: Column) -> Column:
    text = F.concat(tries.cast("string"), F.lit("/"), F.coalesce(most.cast("string"), F.lit("-")))
    return F.when(tries.isNull(), fixed.DASH).otherwise(text)
