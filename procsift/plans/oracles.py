"""SQL twins of the catalogue's queries, for DuckDB over the same tables."""

from __future__ import annotations

from procsift.schema import (
    CHAIN_SCORES,
    DUMP_KEYWORDS,
    FEATURES,
    HIDDEN_FLAGS,
    LOLBAS,
    STRONG_INDICATOR_TEXT,
    SUSPICIOUS_KEYWORDS,
    SUSPICIOUS_PARENTS,
)
from procsift.sources.bridge import COMMANDS, EVENT_TYPES, IMAGES, LSASS_PATH


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN (" + ", ".join(map(_text, values)) + ")"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


def _type_case(place: int) -> str:
    cases = " ".join(f"WHEN {_text(k)} THEN {_text(v[place])}" for k, v in EVENT_TYPES.items())
    return f"CASE event_type {cases} END"


def _base(column: str) -> str:
    text = f"lower(trim(coalesce({column}, '')))"
    last = f"string_split(replace({text}, '\\', '/'), '/')[-1]"
    return f"CASE WHEN contains({text}, '/') THEN {last} ELSE {text} END"


_EV = f"""ev AS (
  SELECT event_id, ts AS "timestamp",
    {_type_case(0)} AS event_type,
    {_type_case(1)} AS source,
    CASE WHEN event_id % 41 <> 0
      THEN ({_list(IMAGES)})[CAST((event_id * 7 + user_id) % 16 + 1 AS INTEGER)] END AS process_image,
    CASE WHEN event_id % 37 <> 0
      THEN ({_list(IMAGES)})[CAST(((event_id % 11) * (user_id % 4) + 2) % 16 + 1 AS INTEGER)] END AS parent_image,
    CASE WHEN event_id % 29 = 0 THEN NULL
      WHEN event_id % 53 = 0 THEN 'cmd.exe /c ' || repeat('A', 600)
      ELSE ({_list(COMMANDS)})[CAST((event_id * 5 + user_id * 11) % 12 + 1 AS INTEGER)]
        || CASE WHEN user_id % 2 = 0 THEN ' ' || props ELSE '' END END AS command_line,
    CAST(4 + event_id % 997 AS BIGINT) AS pid,
    CASE WHEN event_id % 43 <> 0
      THEN CAST(4 + ((event_id % 997) * 7 + user_id) % 1409 AS BIGINT) END AS ppid,
    CASE WHEN event_type IN ('error', 'signup') AND user_id % 5 = 0
      THEN {_text(LSASS_PATH)} END AS target_image,
    CAST(NULL AS BIGINT) AS target_pid,
    value
  FROM events)"""

_PREP = f"""prep AS (
  SELECT *, {_base("process_image")} AS process_image_base,
    {_base("parent_image")} AS parent_image_base,
    {_base("target_image")} AS target_image_base
  FROM ev
  WHERE "timestamp" IS NOT NULL AND process_image IS NOT NULL AND parent_image IS NOT NULL
    AND pid IS NOT NULL AND ppid IS NOT NULL)"""

_ENTROPY = r"""tokens AS (
  SELECT event_id, unnest(regexp_split_to_array(trim(command_line), '\s+')) AS token
  FROM prep WHERE trim(coalesce(command_line, '')) <> ''),
token_counts AS (SELECT event_id, token, count(*) AS c FROM tokens GROUP BY ALL),
entropy AS (
  SELECT event_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits
  FROM token_counts GROUP BY event_id)"""

_CHAIN = "chain(parent_base, child_base, score) AS (VALUES " + ", ".join(
    f"({_text(p)}, {_text(c)}, CAST({s} AS DOUBLE))" for (p, c), s in CHAIN_SCORES.items()
) + ")"

_FLAG_SUM = " + ".join(
    f"CAST(contains(lower(coalesce(command_line, '')), {_text(f)}) AS INTEGER)" for f in HIDDEN_FLAGS
)

_ROWF = f"""rowf AS (
  SELECT prep.*, value AS anomaly_score,
    CAST({_in("parent_image_base", SUSPICIOUS_PARENTS)} AS INTEGER) AS suspicious_parent,
    coalesce(chain.score, 0.5) AS unusual_chain,
    coalesce(entropy.bits, 0.0) AS cmd_entropy,
    CAST({_any("lower(process_image)", DUMP_KEYWORDS)}
      OR {_any("lower(coalesce(command_line, ''))", DUMP_KEYWORDS)}
      OR {_any("lower(coalesce(target_image, ''))", DUMP_KEYWORDS)}
      OR contains(target_image_base, 'lsass') AS INTEGER) AS dump_precursor,
    CAST({_FLAG_SUM} AS INTEGER) AS hidden_flags,
    (CAST({_in("process_image_base", LOLBAS)} AS INTEGER)
      + CAST({_in("parent_image_base", LOLBAS)} AS INTEGER)) / 2.0::DOUBLE AS lolbin_ratio,
    CAST(coalesce(TRY_CAST(event_type AS DOUBLE) IN (8, 10), false) AS INTEGER) AS event_type_access,
    CAST(contains(target_image_base, 'lsass') AS INTEGER) AS has_target_lsass,
    CAST(length(coalesce(command_line, '')) > 500 AS INTEGER) AS long_cmd
  FROM prep
  LEFT JOIN chain ON parent_image_base = parent_base AND process_image_base = child_base
  LEFT JOIN entropy USING (event_id))"""

_GRAPH = """edges AS (SELECT pid, arg_max(ppid, event_id) AS parent FROM prep GROUP BY pid),
walk(start, cur, depth, path) AS (
  SELECT pid, pid, 0, [pid] FROM edges
  UNION ALL
  SELECT start, parent, depth + 1, list_append(path, parent)
  FROM walk JOIN edges ON cur = edges.pid
  WHERE depth < 20 AND NOT list_contains(path, parent)),
depths AS (SELECT start AS pid, CAST(max(depth) AS BIGINT) AS pid_depth FROM walk GROUP BY start),
first_seen AS (SELECT pid AS parent_pid, min("timestamp") AS seen FROM prep GROUP BY pid),
pairs AS (
  SELECT parent_image_base, process_image_base, count(*) AS n FROM prep GROUP BY ALL)"""

_FEATS = """feats AS (
  SELECT event_id, "timestamp", suspicious_parent, unusual_chain, cmd_entropy, dump_precursor,
    hidden_flags, pid_depth,
    (epoch_us("timestamp") - epoch_us(seen)) / 1e6 AS time_delta_parent,
    lolbin_ratio, event_type_access, has_target_lsass, long_cmd,
    1.0::DOUBLE - pairs.n / (SELECT count(*) FROM prep)::DOUBLE AS rare_parent_child
  FROM rowf LEFT JOIN depths USING (pid) LEFT JOIN first_seen ON ppid = parent_pid
  LEFT JOIN pairs USING (parent_image_base, process_image_base))"""

_LABELS = """composite AS (
  SELECT *, suspicious_parent + dump_precursor + least(hidden_flags, 1) AS composite FROM rowf),
labels AS (
  SELECT *, CAST(dump_precursor = 1 OR composite >=
    (SELECT quantile_cont(composite, 0.95) FROM composite) AS INTEGER) AS is_attack
  FROM composite)"""

_BOUNDS = """bounds AS (
  SELECT quantile_cont(anomaly_score, 0.02) AS q02, quantile_cont(anomaly_score, 0.05) AS q05,
    quantile_cont(anomaly_score, 0.10) AS q10, quantile_cont(anomaly_score, 0.20) AS q20,
    quantile_cont(anomaly_score, 0.25) AS q25, quantile_cont(anomaly_score, 0.50) AS q50,
    quantile_cont(anomaly_score, 0.75) AS q75, quantile_cont(anomaly_score, 0.01) AS q01
  FROM rowf)"""

_STRONG = "(suspicious_parent = 1 OR dump_precursor = 1 OR hidden_flags >= 2)"
_BAND = """CASE WHEN anomaly_score <= q02 THEN 'Critical' WHEN anomaly_score <= q05 THEN 'High'
      WHEN anomaly_score <= q10 THEN 'Medium' WHEN anomaly_score <= q20 THEN 'Low'
      ELSE 'Normal' END"""

_REASONS = """reasons AS (
  SELECT event_id, (
      CASE WHEN contains(p, 'lsass') OR contains(c, 'lsass') OR contains(t, 'lsass')
        THEN ['lsass access'] ELSE [] END ||
      CASE WHEN contains(p, 'vssadmin') OR contains(c, 'vssadmin') OR contains(c, 'shadow')
        THEN ['vssadmin shadow copy pattern'] ELSE [] END ||
      CASE WHEN contains(p, 'ntdsutil') OR contains(c, 'ntds')
        THEN ['ntdsutil/ntds credential pattern'] ELSE [] END ||
      CASE WHEN contains(p, 'procdump') OR contains(c, 'procdump') THEN ['procdump-style access'] ELSE [] END ||
      CASE WHEN contains(p, 'mimikatz') OR contains(c, 'mimikatz') THEN ['mimikatz-style activity'] ELSE [] END ||
      CASE WHEN dump_precursor = 1 AND NOT regexp_matches(p, 'lsass|vssadmin|ntdsutil|procdump|mimikatz')
        AND NOT regexp_matches(c, 'lsass|vssadmin|shadow|ntds|procdump|mimikatz')
        AND NOT contains(t, 'lsass') THEN ['credential dump precursor'] ELSE [] END ||
      CASE WHEN encoded THEN ['encoded PowerShell command line'] ELSE [] END ||
      CASE WHEN hidden_flags >= 2 AND NOT encoded THEN ['hidden/encoding flags in command line'] ELSE [] END ||
      CASE WHEN unusual_chain > 0.7 THEN ['unusual parent-child chain'] ELSE [] END ||
      CASE WHEN cmd_entropy > 2.5 THEN ['high command entropy'] ELSE [] END ||
      CASE WHEN long_cmd = 1 AND NOT encoded THEN ['long/obfuscated command line'] ELSE [] END ||
      CASE WHEN suspicious_parent = 1 AND NOT unusual_chain > 0.7
        THEN ['suspicious parent (cmd/powershell/wmic)'] ELSE [] END
    )[1:3] AS reasons
  FROM (SELECT *, contains(c, 'encodedcommand') OR contains(c, '-enc ') AS encoded
    FROM (SELECT *, lower(process_image) AS p, lower(coalesce(command_line, '')) AS c,
      lower(coalesce(target_image, '')) AS t FROM rowf)))"""

_EXPLAINED = """'Flagged: ' || CASE WHEN len(reasons) = 0 THEN 'anomalous process behavior'
      ELSE array_to_string(reasons, ' + ') END
      || ' (score: ' || printf('%.3f', anomaly_score) || ')'"""

_GATED = f"""gated AS (
  SELECT rowf.*, {_BAND} AS risk_level, anomaly_score < q05 AND {_STRONG} AS flagged,
    CASE WHEN anomaly_score < q05 AND {_STRONG} THEN {_EXPLAINED} ELSE '—' END AS explanation
  FROM rowf JOIN reasons USING (event_id), bounds)"""

_ORDER = {
    "ev": _EV,
    "prep": _PREP,
    "entropy": _ENTROPY,
    "chain": _CHAIN,
    "rowf": _ROWF,
    "graph": _GRAPH,
    "feats": _FEATS,
    "labels": _LABELS,
    "bounds": _BOUNDS,
    "reasons": _REASONS,
    "gated": _GATED,
}
_NEEDS = {
    "ev": ["ev"],
    "prep": ["ev", "prep"],
    "rowf": ["ev", "prep", "entropy", "chain", "rowf"],
}
_NEEDS["graph"] = [*_NEEDS["prep"], "graph"]
_NEEDS["feats"] = [*_NEEDS["rowf"], "graph", "feats"]
_NEEDS["labels"] = [*_NEEDS["rowf"], "labels"]
_NEEDS["bounds"] = [*_NEEDS["rowf"], "bounds"]
_NEEDS["reasons"] = [*_NEEDS["rowf"], "reasons"]
_NEEDS["gated"] = [*_NEEDS["rowf"], "bounds", "reasons", "gated"]


def _sql(needs: str, body: str) -> str:
    wanted = {part for need in needs.split() for part in _NEEDS[need]}
    parts = [sql for name, sql in _ORDER.items() if name in wanted]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


_CORE = """"timestamp", event_type, process_image, parent_image, {command} AS command_line,
  pid, ppid, source"""
_PLAIN = _CORE.format(command="command_line")
_XML = _CORE.format(command="nullif(command_line, '')")

ORACLES: dict[str, str] = {}
_add = ORACLES.__setitem__

_add("ingest_ndjson", _sql("ev", f"SELECT {_PLAIN} FROM ev WHERE source = 'falcon'"))
_add("ingest_xml_4688", _sql("ev", f"SELECT {_XML} FROM ev WHERE source = 'security_4688'"))
_add(
    "ingest_xml_sysmon",
    _sql("ev", f"SELECT {_XML}, target_image, target_pid FROM ev WHERE source = 'sysmon'"),
)
_add(
    "ingest_ndjson_millis",
    _sql(
        "ev",
        "SELECT "
        + _PLAIN.replace('"timestamp"', """date_trunc('millisecond', "timestamp") AS "timestamp\"""")
        + " FROM ev WHERE source = 'falcon'",
    ),
)
_add("ingest_sysmon_created", ORACLES["ingest_xml_sysmon"])
_add(
    "malformed_counts",
    _sql(
        "ev",
        """SELECT source, count(*) + count(*) FILTER (WHERE event_id % 97 = 0) AS lines,
  count(*) FILTER (WHERE event_id % 97 = 0) AS malformed FROM ev GROUP BY source""",
    ),
)
_add(
    "quarantined_lines",
    _sql(
        "ev",
        """SELECT CASE source
    WHEN 'falcon' THEN ['', '{broken', '[1]', '{"a": 1} extra'][CAST(event_id // 97 % 4 + 1 AS INTEGER)]
    WHEN 'security_4688' THEN ['', '<bad', '<Event></Evt>', '   '][CAST(event_id // 97 % 4 + 1 AS INTEGER)]
    ELSE ['', '<bad', '<Event><System>', 'no xml'][CAST(event_id // 97 % 4 + 1 AS INTEGER)] END AS value
FROM ev WHERE event_id % 97 = 0""",
    ),
)
_add(
    "process_creation_rows",
    _sql(
        "ev",
        """SELECT "timestamp", event_type, pid, ppid FROM ev WHERE event_type = 'ProcessRollup2'""",
    ),
)
_add(
    "sysmon_event_filter",
    _sql(
        "ev",
        """SELECT "timestamp", event_type, pid, target_image FROM ev
WHERE source = 'sysmon' AND event_type IN ('8', '10')""",
    ),
)
_both = _CORE.format(
    command="CASE WHEN source = 'falcon' THEN command_line ELSE nullif(command_line, '') END"
)
_all_sources = f"SELECT {_both}, target_image, target_pid FROM ev"
_add("union_sources", _sql("ev", _all_sources))
_add("stream_ingest", _sql("ev", _all_sources))
_add(
    "parse_hex_ids",
    _sql("ev", "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN pid END AS parsed_id FROM ev"),
)
_names = [
    "timestamp", "event_type", "process_image", "parent_image", "command_line",
    "pid", "ppid", "source", "target_image", "target_pid",
]
_add(
    "null_summary",
    _sql(
        "ev",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS nulls FROM ev""" for c in _names
        ),
    ),
)
_add("event_type_counts", _sql("ev", "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type"))
_match = f"regexp_matches(lower(coalesce(command_line, '')), '{'|'.join(SUSPICIOUS_KEYWORDS)}')"
_add(
    "suspicious_keyword_rows", _sql("ev", f"SELECT event_id, command_line FROM ev WHERE {_match}")
)
_add("suspicious_keyword_count", _sql("ev", f"SELECT count(*) AS n FROM ev WHERE {_match}"))
_add(
    "suspicious_preview",
    _sql(
        "ev",
        f"""SELECT event_id, event_type, process_image, command_line FROM ev WHERE {_match}
ORDER BY event_id LIMIT 5""",
    ),
)
_add(
    "prep_events",
    _sql(
        "prep",
        """SELECT event_id, "timestamp", event_type, pid, ppid, process_image_base,
  parent_image_base, target_image_base FROM prep""",
    ),
)
_filled = " + ".join(
    f"""CAST("{c}" IS NOT NULL AS INTEGER)"""
    for c in ("timestamp", "process_image", "parent_image", "pid", "ppid")
)
_add("partly_complete_events", _sql("ev", f"SELECT event_id FROM ev WHERE {_filled} >= 3"))
_add(
    "windows_basenames",
    _sql(
        "ev",
        """SELECT event_id,
  string_split(replace(lower(trim(coalesce(process_image, ''))), '\\', '/'), '/')[-1] AS base FROM ev""",
    ),
)

_ROUNDED = {
    "unusual_chain", "cmd_entropy", "lolbin_ratio", "time_delta_parent", "rare_parent_child",
}


def _feature(name: str) -> str:
    return f"round({name}, 6) + 0.0 AS {name}" if name in _ROUNDED else name


for _name in FEATURES:
    _source = "feats" if _name in ("pid_depth", "time_delta_parent", "rare_parent_child") else "rowf"
    _add(f"feat_{_name}", _sql(_source, f"SELECT event_id, {_feature(_name)} FROM {_source}"))
_add(
    "features_all",
    _sql("feats", 'SELECT event_id, "timestamp", ' + ", ".join(map(_feature, FEATURES)) + " FROM feats"),
)
_add(
    "feature_matrix",
    _sql(
        "feats",
        "SELECT event_id, "
        + ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0.0), 6) + 0.0 AS {c}" for c in FEATURES)
        + " FROM feats",
    ),
)
_add("heuristic_labels", _sql("labels", "SELECT event_id, is_attack FROM labels"))
_add(
    "label_classes",
    _sql(
        "labels",
        """SELECT count(*) FILTER (WHERE is_attack = 1) AS positive,
  count(*) FILTER (WHERE is_attack = 0) AS negative FROM labels""",
    ),
)
_add(
    "top_suspicious",
    _sql(
        "rowf",
        """SELECT event_id, "timestamp", process_image, parent_image, command_line,
  suspicious_parent, dump_precursor, hidden_flags,
  suspicious_parent + dump_precursor + hidden_flags AS suspicion
FROM rowf ORDER BY suspicion DESC, event_id LIMIT 20""",
    ),
)


def _correlation_cells() -> str:
    cells = []
    for a in FEATURES:
        for b in FEATURES:
            x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            sx = f"stddev_pop({x}) FILTER (WHERE {b} IS NOT NULL)"
            sy = f"stddev_pop({y}) FILTER (WHERE {a} IS NOT NULL)"
            cells.append(
                f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b,
  round(covar_pop({x}, {y}) / nullif({sx} * {sy}, 0), 6) + 0.0 AS correlation FROM stored"""
            )
    return "\nUNION ALL ".join(cells)


_add(
    "feature_correlation",
    _sql("feats", "").rstrip() + ",\nstored AS MATERIALIZED (SELECT * FROM feats)\n" + _correlation_cells(),
)


def _histograms() -> str:
    parts = []
    for c in FEATURES[:8]:
        parts.append(
            f"""SELECT '{c}' AS feature, bins.bin, round(lo + (bins.bin - 1) * w, 6) + 0.0 AS lo,
  round(lo + bins.bin * w, 6) + 0.0 AS hi, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, k + 1)) AS bin, lo, w FROM shape_{c}) bins
LEFT JOIN (SELECT least(k, greatest(1, CAST(floor((x - lo) / w) AS BIGINT) + 1)) AS bin, count(*) AS n
  FROM (SELECT CAST({c} AS DOUBLE) AS x FROM stored WHERE {c} IS NOT NULL), shape_{c} GROUP BY 1) counts
ON bins.bin = counts.bin"""
        )
    return "\nUNION ALL ".join(parts)


def _histogram_shapes() -> str:
    shapes = []
    for c in FEATURES[:8]:
        shapes.append(
            f"""shape_{c} AS (SELECT k, lo, (hi - lo) / k AS w FROM (
  SELECT least(50, greatest(10, count(DISTINCT {c}))) AS k,
    CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END::DOUBLE AS lo,
    CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END::DOUBLE AS hi FROM stored))"""
        )
    return ",\n".join(shapes)


_add(
    "feature_histograms",
    _sql("feats", "").rstrip()
    + ",\nstored AS MATERIALIZED (SELECT * FROM feats),\n"
    + _histogram_shapes()
    + "\n"
    + _histograms(),
)

_add(
    "score_describe",
    _sql(
        "bounds",
        """SELECT count(anomaly_score) AS count, round(avg(anomaly_score), 6) AS mean,
  round(stddev_samp(anomaly_score), 6) AS std, round(min(anomaly_score), 6) AS min,
  round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50,
  round(any_value(q75), 6) AS q75, round(max(anomaly_score), 6) AS max
FROM rowf, bounds""",
    ),
)
_add(
    "score_quantiles",
    _sql(
        "bounds",
        """SELECT 0.02::DOUBLE AS p, round(q02, 6) AS score FROM bounds
UNION ALL SELECT 0.05, round(q05, 6) FROM bounds
UNION ALL SELECT 0.10, round(q10, 6) FROM bounds
UNION ALL SELECT 0.20, round(q20, 6) FROM bounds""",
    ),
)
_add(
    "score_histogram",
    _sql("rowf", "").rstrip()
    + """,
shape AS (SELECT k, lo, (hi - lo) / k AS w FROM (
  SELECT least(50, count(*)) AS k, min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM rowf))
SELECT bins.bin, round(lo + (bins.bin - 1) * w, 6) AS lo, round(lo + bins.bin * w, 6) AS hi,
  coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, k + 1)) AS bin, lo, w FROM shape) bins
LEFT JOIN (SELECT least(k, greatest(1, CAST(floor((anomaly_score - lo) / w) AS BIGINT) + 1)) AS bin,
  count(*) AS n FROM rowf, shape GROUP BY 1) counts ON bins.bin = counts.bin""",
)
_add(
    "score_bins20",
    _sql("rowf", "").rstrip()
    + """,
shape AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi,
  (max(anomaly_score) - min(anomaly_score)) / 20 AS w FROM rowf)
SELECT bins.bin,
  round(CASE WHEN bins.bin = 1 THEN lo - 0.001 * (hi - lo) ELSE lo + (bins.bin - 1) * w END, 6) AS lo,
  round(lo + bins.bin * w, 6) AS hi, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 21)) AS bin, lo, hi, w FROM shape) bins
LEFT JOIN (SELECT least(20, greatest(1, CAST(ceil((anomaly_score - lo) / w) AS BIGINT))) AS bin,
  count(*) AS n FROM rowf, shape GROUP BY 1) counts ON bins.bin = counts.bin""",
)
_add(
    "top_anomalies",
    _sql(
        "rowf",
        """SELECT event_id, "timestamp", process_image, parent_image, command_line, anomaly_score
FROM rowf ORDER BY anomaly_score, event_id LIMIT 20""",
    ),
)


def _metrics(hit: str, source: str) -> str:
    return f"""SELECT tp, fp, fn,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0.0), 6) AS f1
FROM (SELECT count(*) FILTER (WHERE {hit} AND is_attack = 1) AS tp,
  count(*) FILTER (WHERE {hit} AND is_attack = 0) AS fp,
  count(*) FILTER (WHERE NOT ({hit}) AND is_attack = 1) AS fn FROM {source})"""


_add("anomaly_metrics", _sql("labels bounds", _metrics("anomaly_score < q05", "labels, bounds")))
_add("labelled_predictions", _sql("labels", "SELECT event_id, is_attack FROM labels"))
_add("label_overlap", _sql("labels", "SELECT event_id FROM labels WHERE is_attack = 1"))
_add(
    "scored_with_trace",
    _sql(
        "prep",
        """SELECT ev.event_id, ev.value AS anomaly_score, prep."timestamp", prep.source,
  prep.command_line, prep.process_image, prep.parent_image, prep.event_type
FROM ev LEFT JOIN prep USING (event_id)""",
    ),
)
_add(
    "scored_with_features",
    _sql(
        "rowf",
        """SELECT ev.event_id, ev."timestamp", ev.value AS anomaly_score, suspicious_parent,
  hidden_flags, long_cmd FROM ev LEFT JOIN rowf USING (event_id)""",
    ),
)
_add("risk_levels", _sql("bounds", f"SELECT event_id, {_BAND} AS risk_level FROM rowf, bounds"))
_add(
    "custom_risk_levels",
    _sql(
        "bounds",
        """SELECT event_id, CASE WHEN anomaly_score <= q01 THEN 'Critical'
  WHEN anomaly_score <= q50 THEN 'Medium' ELSE 'Normal' END AS risk_level FROM rowf, bounds""",
    ),
)
_add("strong_indicator", _sql("rowf", f"SELECT event_id, {_STRONG} AS strong FROM rowf"))
_add("gated_flags", _sql("gated", "SELECT event_id, flagged FROM gated"))
_add(
    "explanations",
    _sql("gated", "SELECT event_id, anomaly_score, risk_level, flagged, explanation FROM gated"),
)
_add(
    "reasons_of_all_rows",
    _sql(
        "reasons", f"SELECT event_id, {_EXPLAINED} AS explanation FROM rowf JOIN reasons USING (event_id)"
    ),
)
_add(
    "format_top_features",
    _sql("rowf", "").rstrip()
    + """,
entries AS (
  SELECT event_id, 0 AS pos, 'score' AS name, anomaly_score - 50.0::DOUBLE AS v FROM rowf
  UNION ALL SELECT event_id, 1, 'flags', hidden_flags - 1.25::DOUBLE FROM rowf
  UNION ALL SELECT event_id, 2, 'lolbin', -lolbin_ratio FROM rowf
  UNION ALL SELECT event_id, 3, 'chain', unusual_chain FROM rowf),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(v) DESC, pos) AS place FROM entries)
SELECT event_id, coalesce(' | Top features: ' || string_agg(
  name || ' (' || printf('%+.2f', v) || ')', ', ' ORDER BY place)
  FILTER (WHERE place <= 3 AND abs(v) >= 1e-9), '') AS suffix
FROM ranked GROUP BY event_id""",
)
_labelled = "(SELECT labels.*, anomaly_score < q05 AND " + _STRONG + " AS flagged FROM labels, bounds)"
_add("gate_metrics", _sql("labels bounds", _metrics("flagged", _labelled)))
_add(
    "confusion_matrix",
    _sql(
        "labels bounds",
        f"""SELECT CAST(c.k AS INTEGER) AS is_attack,
  count(is_attack) FILTER (WHERE NOT flagged) AS predicted_0,
  count(is_attack) FILTER (WHERE flagged) AS predicted_1
FROM (VALUES (0), (1)) c(k) LEFT JOIN {_labelled} l ON l.is_attack = c.k GROUP BY c.k""",
    ),
)
_add(
    "pattern_sanity",
    _sql(
        "gated",
        """SELECT pattern, hits, n_flagged, hits = 0 AND n_flagged > 0 AS warn FROM (
  SELECT pattern, CAST(coalesce(sum(CAST(contains(lower(coalesce(command_line, '')), pattern) AS BIGINT)
    + CAST(contains(lower(process_image), pattern) AS BIGINT)), 0) AS BIGINT) AS hits,
    count(event_id) AS n_flagged
  FROM (VALUES ('vssadmin'), ('lsass'), ('ntdsutil')) k(pattern)
  LEFT JOIN (SELECT * FROM gated WHERE flagged) g ON true GROUP BY pattern)""",
    ),
)
_add(
    "top_flagged",
    _sql(
        "gated",
        """SELECT event_id, "timestamp", process_image, parent_image, command_line, anomaly_score,
  risk_level, explanation FROM gated WHERE flagged ORDER BY anomaly_score, event_id LIMIT 20""",
    ),
)
_add(
    "threshold_config",
    _sql(
        "bounds",
        f"""SELECT round(q05, 6) AS score_threshold, 0.02::DOUBLE AS critical, 0.05::DOUBLE AS high,
  0.1::DOUBLE AS medium, 0.2::DOUBLE AS low,
  '{STRONG_INDICATOR_TEXT}' AS strong_indicator_definition, false AS shap_enabled FROM bounds""",
    ),
)
_add(
    "intake_validation",
    _sql(
        "ev",
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_id % 5 <> 0 AND "timestamp" IS NOT NULL)
    AS n_timestamps,
  count(*) FILTER (WHERE event_id % 7 <> 0 AND pid IS NOT NULL) AS n_pids,
  count(*) FILTER (WHERE event_id % 11 <> 0 AND ppid IS NOT NULL) AS n_ppids,
  true AS accepted FROM ev""",
    ),
)
_EV_BOUNDS = """,
evq AS (SELECT quantile_cont(value, 0.02) AS q02, quantile_cont(value, 0.05) AS q05,
  quantile_cont(value, 0.10) AS q10, quantile_cont(value, 0.20) AS q20 FROM ev),
banded AS (SELECT ev.*, CASE WHEN value <= q02 THEN 'Critical' WHEN value <= q05 THEN 'High'
  WHEN value <= q10 THEN 'Medium' WHEN value <= q20 THEN 'Low' ELSE 'Normal' END AS risk_level
  FROM ev, evq)
"""
_add(
    "intake_events",
    _sql("ev", "").rstrip()
    + _EV_BOUNDS
    + """SELECT event_id, process_image, parent_image, pid, ppid, risk_level,
  risk_level <> 'Normal' AS flagged, '' AS explanation FROM banded""",
)
_add(
    "fill_risk_flagged",
    _sql(
        "bounds",
        f"""SELECT event_id, anomaly_score, risk_level, risk_level <> 'Normal' AS flagged, '' AS explanation
FROM (SELECT *, {_BAND} AS risk_level FROM rowf, bounds)""",
    ),
)
_add("alert_set", _sql("gated", "SELECT event_id FROM gated WHERE flagged"))
_add("alert_set_by_band", _sql("gated", "SELECT event_id FROM gated WHERE risk_level <> 'Normal'"))
_add(
    "kpi_summary",
    _sql(
        "gated",
        """SELECT count(*) AS total, count(*) FILTER (WHERE flagged) AS flagged,
  round(coalesce(100.0::DOUBLE * count(*) FILTER (WHERE flagged) / nullif(count(*), 0)::DOUBLE, 0.0), 6)
    AS pct_flagged FROM gated""",
    ),
)
for _name, _column in (("top_images", "process_image"), ("top_parents", "parent_image")):
    _add(
        _name,
        _sql(
            "gated",
            f"""SELECT {_column}, count(*) AS n FROM gated WHERE flagged AND {_column} IS NOT NULL
GROUP BY {_column} ORDER BY n DESC, {_column} LIMIT 3""",
        ),
    )
_add(
    "risk_distribution",
    _sql("gated", "SELECT risk_level, count(*) AS n FROM gated GROUP BY risk_level"),
)
_add(
    "triage_view",
    _sql(
        "gated",
        """SELECT event_id, "timestamp", risk_level, process_image, parent_image,
  left(coalesce(command_line, ''), 80) AS command_line, explanation, anomaly_score
FROM gated WHERE flagged AND risk_level IN ('Critical', 'High')
  AND regexp_matches(lower(coalesce(command_line, '')), 'powershell|vssadmin')""",
    ),
)
_add(
    "triage_latest",
    _sql(
        "gated",
        """SELECT event_id, "timestamp", command_line FROM gated
WHERE flagged AND risk_level <> 'Normal' ORDER BY "timestamp" DESC, event_id LIMIT 20""",
    ),
)
_add(
    "keyword_filter",
    _sql(
        "rowf",
        r"""SELECT event_id FROM rowf
WHERE regexp_matches(lower(coalesce(command_line, '')), 'lsass|-enc\b')""",
    ),
)
_add(
    "risk_ranks",
    _sql(
        "gated",
        """SELECT event_id, CAST(list_position(['Critical', 'High', 'Medium', 'Low', 'Normal'], risk_level) - 1
  AS INTEGER) AS risk_rank FROM gated""",
    ),
)
_add(
    "stream_alerts",
    _sql(
        "feats gated",
        """SELECT event_id, pid_depth, round(time_delta_parent, 6) + 0.0 AS time_delta_parent,
  round(feats.rare_parent_child, 6) + 0.0 AS rare_parent_child, risk_level, explanation
FROM gated JOIN feats USING (event_id) WHERE flagged""",
    ),
)

# The events as raw logs give them: ids in the order of sources and lines, a
# blank XML item is null, and a score of columns that logs have.
_LOGGED = """,
ev AS (
  SELECT row_number() OVER (ORDER BY CASE source WHEN 'falcon' THEN 0 WHEN 'security_4688' THEN 1 ELSE 2 END,
      event_id) - 1 AS event_id,
    "timestamp", event_type, source, process_image, parent_image,
    CASE WHEN source = 'falcon' THEN command_line ELSE nullif(command_line, '') END AS command_line,
    pid, ppid, target_image, target_pid, (pid * 31 + ppid * 17) % 1009 / 1009.0::DOUBLE - 0.02::DOUBLE AS value
  FROM view_events)"""
_add(
    "stream_end_to_end",
    _sql(
        "feats gated",
        """SELECT source, gated."timestamp", pid, ppid, command_line, pid_depth,
  round(time_delta_parent, 6) + 0.0 AS time_delta_parent,
  round(feats.rare_parent_child, 6) + 0.0 AS rare_parent_child, risk_level, explanation
FROM gated JOIN feats USING (event_id) WHERE flagged""",
    ).replace(_EV, "view_" + _EV.replace("ev AS (", "events AS (", 1) + _LOGGED, 1),
)

# --- the same results by other ways ----------------------------------------------

for _name, _twin in {
    "score_quantiles_split": "score_quantiles",
    "pid_depth_shuffled": "feat_pid_depth",
    "rare_pair_shuffled": "feat_rare_parent_child",
    "job_ingest": "union_sources",
    "job_features": "features_all",
    "job_labels": "heuristic_labels",
    "job_gate": "explanations",
    "stream_alerts_reloaded": "stream_alerts",
}.items():
    _add(_name, ORACLES[_twin])
_add(
    "ingested_event_ids",
    _sql(
        "ev",
        """SELECT row_number() OVER (ORDER BY CASE source WHEN 'falcon' THEN 0 WHEN 'security_4688' THEN 1 ELSE 2 END,
    event_id) - 1 AS event_id, source, "timestamp", pid,
  CASE WHEN source = 'falcon' THEN command_line ELSE nullif(command_line, '') END AS command_line FROM ev""",
    ),
)
_add(
    "any_label_overlap",
    "SELECT 'all' AS labels, count(*) > 0 AS overlap FROM events UNION ALL SELECT 'shifted', false",
)
_add(
    "intake_rejections",
    """SELECT * FROM (VALUES ('good.parquet', true), ('no_pid.parquet', false), ('events.json', false))
t("file", accepted) WHERE (SELECT count(*) FROM events) > 0""",
)
_add(
    "job_gate_config",
    _sql("bounds", "SELECT round(q05, 6) AS score_threshold, false AS shap_enabled FROM bounds"),
)
_add(
    "job_triage",
    _sql(
        "gated",
        "SELECT event_id, risk_level FROM gated WHERE flagged AND risk_level IN ('Critical', 'High')",
    ),
)
_add(
    "forest_shape",
    _sql(
        "prep",
        """SELECT CAST(t.range AS INTEGER) AS tree, CAST(least(256, n) AS BIGINT) AS root_size,
  CAST(least(256, n) AS BIGINT) AS leaf_rows, true AS depth_ok
FROM range(150) t, (SELECT count(*) AS n FROM prep)""",
    ),
)
_add(
    "forest_alert_rate",
    _sql("prep", "SELECT count(*) AS n_rows, true AS rate_ok, CAST(0 AS BIGINT) AS odd_rows FROM prep"),
)
_add(
    "importance_sum",
    _sql(
        "prep",
        f"""SELECT CAST({len(FEATURES)} AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS negative
FROM (SELECT count(*) AS n FROM prep) WHERE n > 0""",
    ),
)
_add(
    "attribution_sum",
    _sql("prep", "SELECT count(*) > 0 AS any_row, true AS sums_ok FROM prep"),
)
_add(
    "flagged_suffix",
    _sql(
        "prep",
        """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS flagged_without, CAST(0 AS BIGINT) AS others_with
FROM prep""",
    ),
)
_add(
    "job_gate_report",
    f"""SELECT 'patterns' AS part, pattern AS name, CAST(hits AS DOUBLE) AS value FROM ({ORACLES["pattern_sanity"]})
UNION ALL SELECT 'metrics', name, value FROM (UNPIVOT (
  SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, precision, recall, f1
  FROM ({ORACLES["gate_metrics"]})) ON tp, fp, fn, precision, recall, f1 INTO NAME name VALUE value)
UNION ALL SELECT 'confusion', is_attack || ' predicted_' || k, CAST(CASE k WHEN 0 THEN predicted_0 ELSE predicted_1 END AS DOUBLE)
FROM ({ORACLES["confusion_matrix"]}), (VALUES (0), (1)) t(k)
UNION ALL SELECT 'top', event_id || ' ' || risk_level, round(anomaly_score, 6) FROM ({ORACLES["top_flagged"]})""",
)
_add(
    "job_eda",
    f"""SELECT 'correlation' AS part, feature_a || ' ' || feature_b AS name, correlation AS value
FROM ({ORACLES["feature_correlation"]})
UNION ALL SELECT 'histogram', feature || ' ' || bin, CAST(n AS DOUBLE) FROM ({ORACLES["feature_histograms"]})""",
)
_add(
    "job_top_csv",
    _sql(
        "rowf",
        """SELECT event_id, process_image, suspicious_parent + dump_precursor + hidden_flags AS suspicion
FROM rowf ORDER BY suspicion DESC, event_id LIMIT 20""",
    ),
)
_add(
    "job_score",
    _sql(
        "prep",
        """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS other_scores, count(*) AS with_trace, true AS rate_ok,
  CAST(150 AS BIGINT) AS trees FROM prep""",
    ),
)
_add(
    "job_score_report",
    _sql(
        "prep",
        """SELECT count(*) AS described, count(*) AS in_histogram, true AS q05_ok, true AS q10_ok,
  true AS metrics_ok, true AS top_ok, least(count(*), 20) AS listed FROM prep""",
    ),
)
_add(
    "importance_order",
    _sql(
        "prep",
        f"""SELECT CAST({len(FEATURES)} AS BIGINT) AS features, true AS ordered
FROM (SELECT count(*) AS n FROM prep) WHERE n > 0""",
    ),
)
_add(
    "job_gate_attributed",
    _sql(
        "prep",
        """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS flagged_without, CAST(0 AS BIGINT) AS others_with,
  true AS enabled_ok, true AS snapshot_ok FROM prep""",
    ),
)
