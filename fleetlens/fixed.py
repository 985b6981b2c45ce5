"""Names, labels, limits and patterns that results must agree on.

Nothing here is computed. Every value is part of the data contract: changing one changes
what users see, so they are kept together and in plain text.
"""

# --- applications -----------------------------------------------------------------------

DEFAULT_APP_STATES = ["RUNNING"]

APP_STATE_CLASS = {
    "RUNNING": "running",
    "FINISHED": "success",
    "FAILED": "failure",
    "KILLED": "stopped",
}
DEFAULT_CLASS = "neutral"

BADGE_TYPE = {
    "success": "success",
    "failure": "danger",
    "running": "primary",
    "paused": "warning",
    "stopped": "info",
    "neutral": "info",
}
DEFAULT_BADGE = "info"

# (column, visible unless the user says otherwise), in display order
APP_COLUMNS = [
    ("name", True),
    ("state", True),
    ("user", True),
    ("id", True),
    ("queue", True),
    ("finalStatus", False),
    ("startedTime", True),
    ("finishedTime", True),
    ("elapsedTime", True),
    ("amHostHttpAddress", True),
    ("amRPCAddress", False),
    ("allocatedVCores", True),
    ("allocatedMB", True),
    ("runningContainers", True),
    ("queueUsagePercentage", True),
    ("memorySeconds", False),
    ("vcoreSeconds", False),
    ("clusterUsagePercentage", False),
    ("preemptedResourceMB", False),
    ("preemptedResourceVCores", False),
    ("numNonAMContainerPreempted", False),
    ("numAMContainerPreempted", False),
    ("logAggregationStatus", True),
    ("progress", False),
    ("diagnostics", False),
    ("clusterId", False),
    ("applicationType", True),
    ("applicationTags", False),
    ("priority", False),
    ("unmanagedApplication", False),
    ("appNodeLabelExpression", False),
    ("amNodeLabelExpression", False),
]

REFRESH_SECONDS = [10, 15, 30, 60, 120]
DEFAULT_REFRESH_SECONDS = 30

APP_ID_PATTERN = r"application_\d+_\d+"

# --- workflows --------------------------------------------------------------------------

# code -> (label, tag type); the running code really is spelled this way
WORKFLOW_STATES = {
    "RUNNING_EXEUTION": ("运行中", "primary"),
    "SUCCESS": ("成功", "success"),
    "FAILURE": ("失败", "danger"),
    "PAUSE": ("暂停", "warning"),
    "STOP": ("停止", "info"),
    "SUBMITTED_SUCCESS": ("已提交", "info"),
    "KILL": ("已终止", "info"),
}
EXTRA_STATE_LABELS = {
    "RUNNING_EXECUTION": "运行中",
    "READY_PAUSE": "待暂停",
    "READY_STOP": "待停止",
    "DELAY_EXECUTION": "延迟执行",
    "SERIAL_WAIT": "串行等待",
    "NEED_FAULT_TOLERANCE": "需容错",
    "TIMEOUT": "超时",
    "WAITING_DEPEND": "等待依赖",
    "WAITING_THREAD": "等待线程",
    "WAIT_TO_RUN": "等待运行",
    "WAIT_TO_THREAD": "等待线程池",
    "FORCED_SUCCESS": "强制成功",
}
DEFAULT_TAG = "info"
RUNNING_WORKFLOW_STATES = ["RUNNING_EXEUTION", "SUBMITTED_SUCCESS", "DELAY_EXECUTION", "SERIAL_WAIT"]
RUNNING_ACTIONS = "PAUSE/STOP"
IDLE_ACTION = "REPEAT_RUNNING"

RANGE_HOURS = {"1d": 24, "3d": 72, "7d": 168}
DEFAULT_RANGE = "3d"

DEFAULT_PAGE_ERROR = "查询失败"

LOG_LINES_PER_READ = 500

# --- texts ------------------------------------------------------------------------------

NOT_AVAILABLE = "n/a"
DASH = "—"
JUST_NOW = "刚刚"
MINUTES_AGO = " 分钟前"
HOURS_AGO = " 小时前"
DAYS_AGO = " 天前"
DAY, HOUR, MINUTE, SECOND = "天", "小时", "分", "秒"

MEMORY_UNITS = ["MB", "GB", "TB", "PB"]
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

HIGH_USE, MEDIUM_USE = 85, 60
USE_COLOURS = {"high": "#f56c6c", "medium": "#e6a23c", "normal": "#5e6ad2"}

DEFAULT_NODE_STATE = "In Service"

# --- governed SQL -----------------------------------------------------------------------

SOURCE_TYPES = ["mysql", "oracle"]
SOURCE_PORTS = {"mysql": 3306, "oracle": 1521}
ROW_LIMIT_MODES = ["mysql", "fetch", "rownum"]
LAST_ROWNUM_MAJOR = 11

DEFAULT_ROW_LIMIT = 100
MAX_ROW_LIMIT = 10000
MAX_SQL_CHARS = 32768
QUERY_TIMEOUT_SECONDS = 60
CONNECT_TIMEOUT_SECONDS = 5
AUDIT_SQL_CHARS = 200

READ_ONLY_WORDS = ["SELECT", "SHOW", "DESC", "DESCRIBE", "EXPLAIN", "WITH"]
PROCEDURE_WORDS = ["CALL", "EXEC", "BEGIN"]
TABLE_WORDS = ["FROM", "JOIN", "INTO", "UPDATE", "TABLE"]
OBJECT_NAME = r"[A-Za-z0-9_$.]+"
# how a row cap is written; the number stands in one of the three groups
ROW_CAP = r"\b(?:LIMIT\s+(\d+)|FETCH\s+FIRST\s+(\d+)\s+ROWS|ROWNUM\s*(?:<=|<)\s*(\d+))"

# settings by key, with the kind of value and the value when left out (None: follows from others)
SOURCE_SETTINGS = [
    ("name", "required", None),
    ("label", "title", None),
    ("type", "word", "mysql"),
    ("host", "text", "127.0.0.1"),
    ("port", "count", None),
    ("user", "text", ""),
    ("password", "text", ""),
    ("service", "text", None),
    ("schema", "text", None),
    ("readOnly", "flag", True),
    ("rowLimit", "word", ""),
    ("path", "text", ""),
]
REGISTRY_SETTINGS = [
    ("datasources", "list", None),
    ("allowedDbs", "names", ()),
    ("queryTimeout", "count", QUERY_TIMEOUT_SECONDS),
    ("connectTimeout", "count", CONNECT_TIMEOUT_SECONDS),
]
POLICY_SETTINGS = [
    ("allowedDbs", "names", ()),
    ("allowedTables", "names", ()),
    ("writableTables", "names", ()),
    ("executableProcedures", "names", ()),
    ("defaultLimit", "count", DEFAULT_ROW_LIMIT),
    ("maxLimit", "count", MAX_ROW_LIMIT),
    ("maxSqlLen", "count", MAX_SQL_CHARS),
    ("queryTimeout", "count", QUERY_TIMEOUT_SECONDS),
]

# what counts as blank at the ends of a text: in statements, and in what people type
STATEMENT_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TYPED_BLANKS = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
