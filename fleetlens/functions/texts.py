"""Looking into texts: ids in logs, error bodies, numbers."""

from pyspark.sql import Column, functions as F

from fleetlens import fixed

PRE_BLOCK = r"(?is)<pre>(.*?)</pre>"

DECIMAL_NUMBER = r"[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
BASED_NUMBER = r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+"
NUMBER = rf"\A(?:{DECIMAL_NUMBER}|{BASED_NUMBER})?\z"


def app_id(text: Column) -> Column:
    """The first application id in a text, null when there is none."""
    return F.nullif(F.regexp_extract(text, fixed.APP_ID_PATTERN, 0), F.lit(""))


def first_lines(text: Column, lines: int) -> Column:
    """The first ``lines`` lines of a text."""
    return F.substring_index(text, "\n", lines)


def app_link(rm: str, app: Column) -> Column:
    return F.concat(F.lit(rm.rstrip("/") + "/cluster/app/"), app)


def remote_error(body: Column, status: Column, status_text: Column) -> Column:
    """What a failed response says: a JSON exception, else a preformatted block, else its status."""
    parsed = F.try_parse_json(body)
    message = F.nullif(F.try_variant_get(parsed, "$.RemoteException.message", "string"), F.lit(""))
    kind = F.nullif(F.try_variant_get(parsed, "$.RemoteException.exception", "string"), F.lit(""))
    named = F.when(kind != "RemoteException", F.concat(kind, F.lit(": "), message)).otherwise(message)
    block = F.btrim(F.regexp_extract(body, PRE_BLOCK, 1), F.lit(fixed.TYPED_BLANKS))
    has_block = F.regexp_extract(body, PRE_BLOCK, 0) != ""
    plain = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" "), status_text)
    return F.when(message.isNotNull(), named).when(has_block, block).otherwise(plain)


def is_numeric(text: Column) -> Column:
    """Whether a browser would read the text as a number; blanks count, the empty text does not."""
    trimmed = F.btrim(text, F.lit(fixed.TYPED_BLANKS))
    return F.coalesce((text != "") & F.rlike(trimmed, F.lit(NUMBER)), F.lit(False))
