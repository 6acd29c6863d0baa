"""The reason text of an alert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procsift.functions.text import lowered

# The reason texts and the two numeric limits.
CHAIN_LIMIT = 0.7
ENTROPY_LIMIT = 2.5
LSASS = "lsass access"
VSSADMIN = "vssadmin shadow copy pattern"
NTDS = "ntdsutil/ntds credential pattern"
PROCDUMP = "procdump-style access"
MIMIKATZ = "mimikatz-style activity"
DUMP = "credential dump precursor"
ENCODED = "encoded PowerShell command line"
HIDDEN = "hidden/encoding flags in command line"
CHAIN = "unusual parent-child chain"
ENTROPY = "high command entropy"
LONG = "long/obfuscated command line"
PARENT = "suspicious parent (cmd/powershell/wmic)"
NO_REASON = "anomalous process behavior"


def reason_list(
    process: Column,
    command: Column,
    target: Column,
    *,
    dump_precursor: Column,
    hidden_flags: Column,
    unusual_chain: Column,
    cmd_entropy: Column,
    long_cmd: Column,
    suspicious_parent: Column,
) -> Column:
    """All reasons that hold, in rule order, as ARRAY<STRING>.

    A credential-tool rule silences the generic dump rule, the encoded rule
    silences the flag and length rules, the chain rule silences the parent
    rule; that happens before any cut to the first three.
    """
    p, c, t = lowered(process), lowered(command), lowered(target)

    def has(text: Column, word: str) -> Column:
        return F.contains(text, F.lit(word))

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    lsass = has(p, "lsass") | has(c, "lsass") | has(t, "lsass")
    vssadmin = has(p, "vssadmin") | has(c, "vssadmin") | has(c, "shadow")
    ntds = has(p, "ntdsutil") | has(c, "ntds")
    procdump = has(p, "procdump") | has(c, "procdump")
    mimikatz = has(p, "mimikatz") | has(c, "mimikatz")
    named = lsass | vssadmin | ntds | procdump | mimikatz
    encoded = has(c, "encodedcommand") | has(c, "-enc ")
    chain = holds(unusual_chain > CHAIN_LIMIT)

    rules = [
        (lsass, LSASS),
        (vssadmin, VSSADMIN),
        (ntds, NTDS),
        (procdump, PROCDUMP),
        (mimikatz, MIMIKATZ),
        (~named & holds(dump_precursor == 1), DUMP),
        (encoded, ENCODED),
        (~encoded & holds(hidden_flags >= 2), HIDDEN),
        (chain, CHAIN),
        (holds(cmd_entropy > ENTROPY_LIMIT), ENTROPY),
        (~encoded & holds(long_cmd == 1), LONG),
        (~chain & holds(suspicious_parent == 1), PARENT),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))


def reason_text(reasons: Column, score: Column) -> Column:
    """``Flagged: r1 + r2 + r3 (score: -0.123)`` from the first three reasons."""
    first = F.slice(reasons, 1, 3)
    joined = F.when(F.size(first) > 0, F.array_join(first, " + ")).otherwise(
        F.lit(NO_REASON)
    )
    shown = F.when(
        score.isNull() | F.isnan(score), F.lit("N/A")
    ).otherwise(F.format_string("%.3f", score))
    return F.concat(F.lit("Flagged: "), joined, F.lit(" (score: "), shown, F.lit(")"))
