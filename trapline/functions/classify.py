"""Intent classification of typed commands, and the intent dimension."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ordered rules (pattern, intent, technique); the first match wins.
COMMAND_RULES = [
    (r"xmrig|minexmr|hashvault|cryptonight|stratum\+tcp|kdevtmpfsi|kinsing", "cryptomining", "T1496"),
    (r"wget\s+http|curl\s+.*http.*\|\s*sh|curl\s+-[oO].*http|tftp\s+-g", "malware_deployment", "T1105"),
    (r"chmod\s+\+x\s+/tmp|chmod\s+777", "malware_deployment", "T1222"),
    (r"\./[a-z0-9_.]+\s*$|/tmp/\.[a-z]", "malware_deployment", "T1059.004"),
    (r"busybox\s+wget|busybox\s+tftp", "malware_deployment", "T1105"),
    (r"crontab|/var/spool/cron|/etc/cron", "persistence", "T1053.003"),
    (r"authorized_keys", "persistence", "T1098.004"),
    (r"chattr\s+\+i", "persistence", "T1222"),
    (r"nohup\s+.*&|setsid|disown", "persistence", "T1053"),
    (r"/etc/rc\.local|/etc/init\.d|systemctl\s+enable", "persistence", "T1037"),
    (r"cat\s+/etc/shadow|/etc/shadow", "credential_theft", "T1003.008"),
    (r"\.ssh/id_rsa|\.pem|\.key", "credential_theft", "T1552.004"),
    (r"\.bash_history|\.mysql_history", "credential_theft", "T1552.003"),
    (r"my\.cnf|\.pgpass|\.env", "credential_theft", "T1552.001"),
    (r"rm\s+-rf\s+/var/log|rm\s+.*\.log", "sabotage", "T1070.002"),
    (r"history\s+-c|unset\s+HISTFILE", "sabotage", "T1070.003"),
    (r"iptables\s+-F|ufw\s+disable", "sabotage", "T1562.004"),
    (r"pkill|killall|kill\s+-9", "sabotage", "T1489"),
    (r"uname|cat\s+/proc/cpuinfo|cat\s+/etc/issue|lsb_release|arch", "reconnaissance", "T1082"),
    (r"cat\s+/etc/passwd|/etc/group|lastlog|last\b", "reconnaissance", "T1087"),
    (r"whoami\b|id\b|\bw\b", "reconnaissance", "T1033"),
    (r"ifconfig|ip\s+addr|ip\s+route|hostname", "reconnaissance", "T1016"),
    (r"netstat|ss\s+-", "reconnaissance", "T1049"),
    (r"ps\s+aux|ps\s+-ef|top\b", "reconnaissance", "T1057"),
    (r"df\s+-|free\s+-|du\s+-|mount\b", "reconnaissance", "T1082"),
    (r"ls\s|pwd\b|find\s|locate\s", "reconnaissance", "T1083"),
]
UNMATCHED = ("unknown", "T1059")
LOGIN = ("brute_force", "T1110")
TRANSFER = ("malware_deployment", "T1105")

# Fixed values: (intent, technique shown for it, description).
INTENTS = [
    ("brute_force", "T1110", "Repeated login attempts to guess credentials"),
    ("reconnaissance", "T1592", "System enumeration and information gathering"),
    ("malware_deployment", "T1059", "Downloading and executing malicious payloads"),
    ("persistence", "T1053", "Establishing persistent backdoor access"),
    ("cryptomining", "T1496", "Deploying cryptocurrency mining software"),
    ("credential_theft", "T1003", "Stealing passwords and authentication tokens"),
    ("sabotage", "T1485", "Destructive actions against the system"),
    ("lateral_movement", "T1021", "Attempting to pivot to other systems"),
    ("scanning", "T1046", "Port scanning and network reconnaissance"),
    ("data_exfiltration", "T1041", "Extracting sensitive data from the system"),
]

# Case-insensitive, \n as the only line end, Unicode character classes; with the
# four separator control characters counted as space.
_FLAGS = "(?idU)"
_SPACE = r"[\\s\\x1c-\\x1f]"

# Letters that match an ASCII letter in any case without being one.
_FOLD_FROM, _FOLD_TO = "ſıİK", "siik"


def _screen_words(pattern: str) -> list[str]:
    """For each alternative of a rule its longest plain text, which any match contains."""
    words = []
    for alternative in re.split(r"(?<!\\)\|", pattern):
        runs = re.split(r"\\s[+*]?|\\b|\.\*|\[[^\]]*\][+*]?|\$", alternative)
        if any(re.search(r"(?<!\\)[?*+(){}^.]|\\[a-zA-Z0-9]", run) for run in runs):
            raise ValueError(f"no plain text can be read off the rule {pattern!r}")
        words.append(max((re.sub(r"\\(.)", r"\1", run) for run in runs), key=len).lower())
    return words


def verdict(intent: str, technique: str) -> Column:
    return F.struct(F.lit(intent).alias("intent"), F.lit(technique).alias("mitre_id"))


def _rule_sql() -> str:
    """The 1-based number of the first rule that matches ``_command``, else 0."""
    whens = []
    for number, (pattern, _, _) in enumerate(COMMAND_RULES, 1):
        screen = " OR ".join(f"contains(_folded, '{word}')" for word in dict.fromkeys(_screen_words(pattern)))
        spelled = re.sub(r"\\s", _SPACE, pattern)
        whens.append(f"WHEN ({screen}) AND rlike(_command, r'{_FLAGS}{spelled}') THEN {number}")
    return f"CASE {' '.join(whens)} ELSE 0 END"


def _verdict_sql(intent: str, technique: str) -> str:
    return f"named_struct('intent', '{intent}', 'mitre_id', '{technique}')"


# One parsed text each instead of several hundred calls into the JVM per query.
_RULE = _rule_sql()
_VERDICT = f"array({', '.join(_verdict_sql(*v) for v in [UNMATCHED, *[r[1:] for r in COMMAND_RULES]])})[_rule]"
_INTENT_ROWS = ", ".join(
    f"named_struct('intent', '{intent}', 'mitre_id', '{technique}', 'description', '{text}')"
    for intent, technique, text in INTENTS
)


def with_verdict(frame: DataFrame, command: Column, into: str = "found") -> DataFrame:
    """Add struct(intent, mitre_id) of a command; empty, null and unmatched text is unknown.

    A rule's pattern is only tried on text that contains one of its words, which
    is a search of bytes and settles most rules for most commands.  Neither
    helper column is ever null, which keeps the generated code short.
    """
    ascii_only = F.length(command) == F.octet_length(command)
    folded = F.lower(F.when(ascii_only, command).otherwise(F.translate(command, _FOLD_FROM, _FOLD_TO)))
    empty = F.lit("")
    return (
        frame.withColumns({"_command": F.coalesce(command, empty), "_folded": F.coalesce(folded, empty)})
        .withColumn("_rule", F.expr(_RULE))
        .withColumn(into, F.expr(_VERDICT))
        .drop("_command", "_folded", "_rule")
    )


def intent_dim(spark: SparkSession) -> DataFrame:
    """The ten described intents."""
    return spark.range(1).selectExpr(f"inline(array({_INTENT_ROWS}))")
