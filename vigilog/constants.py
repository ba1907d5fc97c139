"""Fixed values that results depend on.

Everything in this file is a fixed value: word lists, patterns, weights, limits and
address ranges whose content decides the output, kept together and in natural order.
"""

# --- field names -----------------------------------------------------------------
# Accepted spellings per logical field, best first.
FIELD_ALIASES = {
    "timestamp": ["@timestamp", "ts", "timestamp", "TimeGenerated"],
    "hostname": ["host.name", "hostname", "host.hostname", "agent.hostname"],
    "username": ["user.name", "username"],
    "src_ip": ["source.ip", "src_ip", "client.ip"],
    "dst_ip": ["destination.ip", "dst_ip", "dest_ip", "server.ip"],
    "event_id": ["event.id", "EventID", "event.code"],
    "severity": ["event.severity", "severity", "log.level"],
    "category": ["event.category", "category"],
    "action": ["event.action", "action"],
    "outcome": ["event.outcome", "outcome"],
    "dst_port": ["destination.port", "dst_port", "port"],
    "bytes_sent": ["network.bytes", "source.bytes", "bytes_sent"],
    "process_name": ["process.name", "Image"],
    "parent_name": ["process.parent.name", "parent_name", "ParentImage"],
    "command_line": ["process.command_line", "command_line", "CommandLine"],
}

# The twelve columns of a raw log file, and those holding nested text.
RAW_COLUMNS = [
    "agent", "process", "@timestamp", "ecs", "data_stream", "elastic",
    "host", "event", "message", "user", "file", "Effective_process",
]
NESTED_COLUMNS = [
    "agent", "process", "ecs", "data_stream", "elastic",
    "host", "event", "user", "file", "Effective_process",
]
# Order in which field namespaces are listed in a profile.
NAMESPACE_ORDER = [
    "process", "event", "host", "file", "user", "agent",
    "ecs", "data_stream", "elastic", "Effective_process",
]
METADATA_COLUMNS = ["_id", "_index", "_score", "_type", "_routing"]

# A text column is tried as a number when its name holds one of these.
NUMERIC_NAME_PARTS = [
    "port", "count", "bytes", "size", "duration", "latency",
    "pid", "code", "status", "severity", "score", "num",
]

# --- severities and levels -------------------------------------------------------
# Severity word to number; anything else is 1.
SEVERITY_NUMBERS = {
    "critical": 4, "high": 3, "medium": 2, "low": 1,
    "informational": 0, "info": 0, "debug": -1, "unknown": 1,
    "4": 4, "3": 3, "2": 2, "1": 1, "0": 0,
}
SEVERITY_DEFAULT = 1
# Rank and points per rule level.
RULE_LEVEL_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "informational": 0, "unknown": -1}
RULE_LEVEL_POINTS = {"critical": 80, "high": 60, "medium": 40, "low": 20, "informational": 10, "unknown": 0}
# Lower bounds of the score levels.
SCORE_LEVELS = [("Critical", 80), ("High", 60), ("Medium", 40), ("Low", 20)]
SCORE_LEVEL_REST = "Info"

# --- words and patterns ----------------------------------------------------------
FAILURE_WORDS = ["failure", "fail", "failed", "error", "denied", "reject"]
ESCALATION_WORDS = ["sudo", "su", "elevated", "privilege_escalation"]
SCRIPT_ENGINES = [
    "powershell.exe", "pwsh.exe", "cmd.exe", "bash", "sh", "zsh", "wscript.exe", "cscript.exe",
]
LIVING_OFF_THE_LAND = [
    "powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe",
    "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe",
    "bitsadmin.exe", "psexec.exe", "wmic.exe", "schtasks.exe",
    "net.exe", "net1.exe", "whoami.exe", "ipconfig.exe",
]
PRIVILEGED_USERS = ["SYSTEM", "Administrator", "root"]
LOOPBACK = ["127.0.0.1", "::1"]
SUSPICIOUS_COMMAND = (
    r"(?i)([A-Za-z0-9+/]{20,}={0,2}|-enc|-ExecutionPolicy\s+Bypass|-nop|-hidden|iex|Invoke-WebRequest|wget|curl)"
)
BASE64_RUN = r"([A-Za-z0-9+/]{30,}={0,2})"
ENCODED_COMMAND = r"base64|encodedcommand|-enc |iex |invoke-expression"
DOWNLOAD_COMMAND = r"wget|curl|downloadstring|bitstransfer"
HIDDEN_COMMAND = r"-w hidden|-windowstyle hidden|bypass"
AUTH_ACTION = r"auth|login|logon"
COMMAND_KEYWORDS = [
    "-enc", "-ExecutionPolicy Bypass", "wget", "curl", "Invoke-WebRequest", "/etc/shadow", "chmod 777",
]
SENSITIVE_PORTS = [4444, 3389, 22, 23]
CRITICAL_HOST_PREFIXES = ["DC-", "PROD-"]

# --- addresses -------------------------------------------------------------------
# Networks registered as not globally reachable, and the exceptions inside them.
PRIVATE_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PUBLIC_INSIDE_PRIVATE_IPV4 = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_IPV6 = [
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
PUBLIC_INSIDE_PRIVATE_IPV6 = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]

# --- scoring ---------------------------------------------------------------------
ANOMALY_THRESHOLD = 0.7
RISK_WEIGHTS = {
    "ml": 0.25, "behaviour": 0.20, "threat_intel": 0.25, "historical": 0.15, "temporal": 0.15,
}
RISK_MEMORY = 0.9
FAILURE_WINDOW = 1000
FAILURES_BEFORE_SUCCESS = 3
ENSEMBLE_WEIGHTS = {
    "iforest": 0.25, "autoencoder": 0.20, "lof": 0.15, "ocsvm": 0.10,
    "statistical": 0.10, "frequency": 0.10, "rolling": 0.10,
}
ENSEMBLE_THRESHOLD = 0.6
EPSILON = 1e-9
GAP_LIMIT_SECONDS = 3600
EMA_SPAN = 10
DEFAULT_PERCENTS = [50, 75, 90, 95, 99]
# Bucket size by length of the range in hours, then the rest.
INTERVAL_BY_HOURS = [(2, "1m"), (24, "1h"), (168, "6h"), (720, "1d"), (2160, "1w")]
INTERVAL_REST = "1M"

# Texts of the risk report.
ACTION_DEFAULT = "Standard log review"
ACTION_BASE64 = "Isolate endpoint immediately"
ACTION_KEYWORD = "Review process tree"
ACTION_PORT = "Block port at firewall"
ACTION_ASSET = "Escalate to Tier 3 Incident Response"
ACTION_BRUTE_FORCE = "Force password reset and revoke active sessions"
TECHNIQUE_BASE64 = "T1027 (Obfuscated Files or Information)"
TECHNIQUE_KEYWORD = "T1059 (Command and Scripting Interpreter)"
TECHNIQUE_PORT = "T1043 (Commonly Used Port)"
TECHNIQUE_ASSET = "T1484 (Domain Policy Modification Target)"
TECHNIQUE_BRUTE_FORCE = "T1110 (Brute Force)"

# Details of the contributors and sentences of the risk report.
REPORT_NEW_USER = "New user detection"
REPORT_NEW_IP = "New IP detection"
REPORT_ODD_COMMAND = "Suspicious command structure"
REPORT_FAILED_OFTEN = "High failed login ratio"
REPORT_BASE64 = "Base64 payload detected"
REPORT_KEYWORD = "Suspicious keyword: "
REPORT_PORT = "Suspicious port connection: "
REPORT_ASSET = "Target is a highly critical asset"
REPORT_PAST = "User has a history of high-risk behavior"
REPORT_MODELS = "High ML ensemble anomaly confidence."
REPORT_BRUTE_FORCE = "Brute-force success pattern"
REASON_MODELS = "was flagged by multiple ML anomaly detection models"
REASON_NEW_USER = "logged in as a completely new user"
REASON_NEW_IP = "originated from a previously unseen IP address"
REASON_ODD_COMMAND = "executed an obfuscated or suspicious command"
REASON_FAILED_OFTEN = "triggered multiple authentication failures"
REASON_BASE64 = "utilized a Base64 encoded payload"
REASON_KEYWORD = "executed known suspicious command '"
REASON_PORT = "connected to sensitive port "
REASON_ASSET = "targeted a critical production asset"
REASON_PAST = "is an account with a history of severe security violations"
REASON_BRUTE_FORCE = "successfully authenticated immediately following a brute-force sequence"
REASON_LEAD = "Risk increased because the activity "
REASON_NONE = "Event occurred within normal baseline parameters with no significant threat indicators."
