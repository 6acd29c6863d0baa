"""Column layout and the fixed values of the process-event data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed layouts: column names and their order are part of every stored table
# and of the model, so they must be what users' other tools expect.
# ---------------------------------------------------------------------------

CORE_COLUMNS = [
    "timestamp",
    "event_type",
    "process_image",
    "parent_image",
    "command_line",
    "pid",
    "ppid",
    "source",
]
TARGET_COLUMNS = ["target_image", "target_pid"]

# ``timestamp`` is a TIMESTAMP_NTZ holding UTC wall-clock time, so no result
# depends on the session time zone.
UNIFIED_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("process_image", T.StringType()),
        T.StructField("parent_image", T.StringType()),
        T.StructField("command_line", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("ppid", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("target_image", T.StringType()),
        T.StructField("target_pid", T.LongType()),
    ]
)

# The model's feature order.
FEATURES = [
    "suspicious_parent",
    "unusual_chain",
    "cmd_entropy",
    "dump_precursor",
    "hidden_flags",
    "pid_depth",
    "time_delta_parent",
    "lolbin_ratio",
    "event_type_access",
    "has_target_lsass",
    "long_cmd",
    "rare_parent_child",
]

TRACE_COLUMNS = [
    "timestamp",
    "source",
    "command_line",
    "process_image",
    "parent_image",
    "event_type",
]

# ---------------------------------------------------------------------------
# Detection lists, rule scores and thresholds. Results depend on
# every one of them, so they are stated as plain text.
# ---------------------------------------------------------------------------

REQUIRED_COLUMNS = ["timestamp", "process_image", "parent_image", "pid", "ppid"]
COMPLETENESS = 0.9

SUSPICIOUS_PARENTS = [
    "cmd.exe",
    "powershell.exe",
    "wmic.exe",
    "rundll32.exe",
    "regsvr32.exe",
]

CHAIN_SCORES = {
    ("explorer.exe", "lsass.exe"): 1.0,
    ("explorer.exe", "lsass"): 1.0,
    ("cmd.exe", "lsass.exe"): 1.0,
    ("powershell.exe", "lsass.exe"): 1.0,
    ("powershell.exe", "mimikatz"): 1.0,
    ("cmd.exe", "procdump"): 0.9,
    ("powershell.exe", "ntdsutil.exe"): 0.9,
    ("cmd.exe", "vssadmin.exe"): 0.8,
    ("services.exe", "svchost.exe"): 0.0,
    ("svchost.exe", "conhost.exe"): 0.0,
}
CHAIN_DEFAULT = 0.5

HIDDEN_FLAGS = [
    "-nop",
    "-noprofile",
    "-w hidden",
    "-windowstyle hidden",
    "-enc",
    "-encodedcommand",
    "-e ",
]

LOLBAS = [
    "certutil.exe",
    "mshta.exe",
    "rundll32.exe",
    "regsvr32.exe",
    "msiexec.exe",
    "wmic.exe",
    "bitsadmin.exe",
    "cmstp.exe",
    "cscript.exe",
    "wscript.exe",
    "msxsl.exe",
    "installutil.exe",
    "reg.exe",
    "msbuild.exe",
    "pcalua.exe",
]

DUMP_KEYWORDS = ["lsass", "procdump", "mimikatz", "ntds", "sekurlsa", "vssadmin"]
SUSPICIOUS_KEYWORDS = ["lsass", "procdump", "rundll32", "mimikatz", "sekurlsa"]
KEY_PATTERNS = ["vssadmin", "lsass", "ntdsutil"]

LONG_COMMAND = 500
MAX_DEPTH = 20
ACCESS_EVENT_TYPES = [8, 10]
LABEL_QUANTILE = 0.95

RISK_QUANTILES = {"Critical": 0.02, "High": 0.05, "Medium": 0.10, "Low": 0.20}
RISK_LEVELS = ["Critical", "High", "Medium", "Low", "Normal"]
GATE_QUANTILE = 0.05
NOT_FLAGGED = "—"
STRONG_INDICATOR_TEXT = (
    "suspicious_parent == 1 OR dump_precursor == 1 OR hidden_flags >= 2"
)

SHORT_COMMAND = 80
# Fixed layout: the columns of an external alert file.
INTAKE_COLUMNS = [
    "timestamp",
    "process_image",
    "parent_image",
    "command_line",
    "pid",
    "ppid",
    "event_type",
]

# The default names of the three raw logs in a data directory.
RAW_FILES = {
    "falcon": "crowdstrike_falcon.txt",
    "security_4688": "4688_windows-security.txt",
    "sysmon": "windows-sysmon.txt",
}
