"""Independent SQL for the registered queries, for a plain SQL engine over the same tables.

Written from the definitions, with global windows and self joins where the Spark side
works in blocks, so the two share no technique.
"""

from __future__ import annotations

from stagewise.operators.resample_curves import POISSON_CDF
from stagewise.plans.queries import BOOTSTRAP_ROUNDS, S, SEEDS

STAGE_LIST = "['Benign','IAD','LMEP','IMP']"


def _stage_name(severity: str) -> str:
    return f"list_extract({STAGE_LIST}, ({severity})::INT + 1)"


def _stage_case(attack: str, **moved: str) -> str:
    table = {"scanning": "IAD", "backdoor": "LMEP", "ransomware": "IMP", **moved}
    return "CASE {} {} WHEN 'normal' THEN 'Benign' ELSE 'IAD' END".format(
        attack, " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()))


def _severity(stage: str) -> str:
    return f"(list_position({STAGE_LIST}, {stage}) - 1)::INT"


def _window(ts: str, width) -> str:
    return f"floor(floor(epoch_us({ts}) / 1e6) / {float(width)!r})::BIGINT"


ATTACK = ("CASE WHEN event_type = 'purchase' AND value >= 100 THEN 'ransomware' WHEN event_type = 'error' THEN 'backdoor' "
          "WHEN event_type = 'signup' THEN 'scanning' ELSE 'normal' END")


def _h(seed, *parts: str) -> str:
    return f"md5('{seed}'" + "".join(f" || '|' || ({p})::VARCHAR" for p in parts) + ")"


def _f1(tp: str, fp: str, fn: str) -> str:
    return f"coalesce(2.0 * ({tp}) / nullif(2 * ({tp}) + ({fp}) + ({fn}), 0), 0)"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def _split_cte(seed) -> str:
    return f"""(SELECT asset_id, CASE WHEN rn <= round_even(n * {S.train_frac}, 0) THEN 'train'
        WHEN rn <= round_even(n * {S.train_frac}, 0) + round_even(n * {S.val_frac}, 0) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT asset_id, row_number() OVER (ORDER BY {_h(seed, 'asset_id')}) AS rn, count(*) OVER () AS n
            FROM (SELECT DISTINCT asset_id FROM rec)))"""


_p = {"m": "value__max / (value__max + 50)", "c": "(event_type__nunique::DOUBLE / (n_records + 1))"}


def _scored(w: float) -> str:
    parts = ["0.45::DOUBLE", f"{w!r}::DOUBLE * {_p['c']}", f"({_p['m']})", f"1.3::DOUBLE * ({_p['m']}) * ({_p['m']})"]
    return f"""(SELECT asset_id, window_id, split, y, p, (list_position(p, list_max(p)) - 1)::INT AS pred FROM (
        SELECT asset_id, window_id, split, y, [{', '.join(f'round(r{i} / (r0 + r1 + r2 + r3), 9)' for i in range(4))}] AS p FROM (
          SELECT asset_id, window_id, severity AS y, {', '.join(f'{x} AS r{i}' for i, x in enumerate(parts))} FROM inst)
        JOIN spl USING (asset_id)))"""


def _mode_of(table: str, keys: str, c: str) -> str:
    return f"""SELECT {keys}, {c} AS {c}__mode FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {c}) AS rn FROM (
        SELECT {keys}, {c}, count(*) AS n FROM {table} GROUP BY {keys}, {c})) WHERE rn = 1"""


# Named building blocks; `sql` pulls in what a query names, in this order.
def _thresholds(rows: str) -> str:
    """Per stage the grid threshold with the best F1 over the given one-vs-rest rows."""
    return f"""(SELECT stage, CASE WHEN P = 0 THEN 0.5 ELSE t END AS threshold FROM (
        SELECT stage, t, P, row_number() OVER (PARTITION BY stage ORDER BY {_f1('tp', 'n - tp', 'P - tp')} DESC, t) AS rn FROM (
          SELECT stage, k / 100.0::DOUBLE AS t, sum(label) AS P, sum(label) FILTER (score >= k / 100.0::DOUBLE) AS tp0,
            coalesce(tp0, 0) AS tp, count(*) FILTER (score >= k / 100.0::DOUBLE) AS n
          FROM {rows}, range(1, 100) g(k) GROUP BY stage, k)) WHERE rn = 1)"""


_TURNED = "(SELECT split, stage, CASE WHEN split = 'test' THEN 1 - label ELSE label END AS label, score FROM ovr)"


def _moved(where: str) -> str:
    """Number of thresholds that differ once test labels are turned round."""
    return f"""(SELECT count(*) FROM {_thresholds(f"(SELECT * FROM ovr WHERE {where})")} a FULL JOIN {_thresholds(f"(SELECT * FROM {_TURNED} WHERE {where})")} b USING (stage)
        WHERE a.threshold IS DISTINCT FROM b.threshold)"""


CTE = {
    "rec": f"""(SELECT *, {_severity('stage_label')} AS severity FROM (SELECT event_id, ts AS "timestamp", user_id::VARCHAR AS asset_id,
        json_extract_string(props, '$.k') AS peer_id, {ATTACK} AS raw_attack_type, value, event_type,
        {_stage_case(ATTACK)} AS stage_label, {_window('ts', S.delta_t_seconds)} AS window_id FROM events))""",
    "spl": _split_cte(S.seed),
    "inst": """(SELECT asset_id, window_id, count(*) AS n_records, min("timestamp") AS window_start_time, avg(value) AS value__mean,
        coalesce(stddev_samp(value), 0) AS value__std, max(value) AS value__max, sum(value) AS value__sum,
        count(DISTINCT event_type) AS event_type__nunique, max(severity)::INT AS severity FROM rec GROUP BY ALL)""",
    "modes": f"({_mode_of('rec', 'asset_id, window_id', 'event_type')})",
    "lab": f"(SELECT asset_id, window_id, severity, {_stage_name('severity')} AS stage_label FROM inst)",
    "labs": "(SELECT lab.*, split FROM lab JOIN spl USING (asset_id))",
    "con": "(SELECT DISTINCT asset_id, peer_id, window_id FROM rec WHERE peer_id IS NOT NULL)",
    "pairs": """(SELECT c.* FROM con c JOIN inst a ON a.asset_id = c.asset_id AND a.window_id = c.window_id
        JOIN inst b ON b.asset_id = c.peer_id AND b.window_id = c.window_id WHERE c.asset_id <> c.peer_id)""",
    "iedge": """(SELECT asset_id AS src_asset, window_id AS src_window, peer_id AS dst_asset, window_id AS dst_window, 'interaction' AS edge_type FROM pairs
        UNION SELECT peer_id, window_id, asset_id, window_id, 'interaction' FROM pairs)""",
    "steps": "(SELECT asset_id, window_id, lead(window_id) OVER (PARTITION BY asset_id ORDER BY window_id) AS nxt FROM inst)",
    "tedge": """(SELECT asset_id AS src_asset, window_id AS src_window, asset_id AS dst_asset, nxt AS dst_window, 'temporal' AS edge_type FROM steps WHERE nxt IS NOT NULL
        UNION ALL SELECT asset_id, nxt, asset_id, window_id, 'temporal' FROM steps WHERE nxt IS NOT NULL)""",
    "edge": "(SELECT * FROM iedge UNION ALL SELECT * FROM tedge)",
    "rep": "(SELECT asset_id, min(window_id) AS w FROM inst GROUP BY ALL)",
    "redge": """(SELECT a.asset_id AS src_asset, a.w AS src_window, b.asset_id AS dst_asset, b.w AS dst_window, 'interaction' AS edge_type FROM (
        SELECT asset_id AS x, peer_id AS y FROM con WHERE asset_id <> peer_id UNION SELECT peer_id, asset_id FROM con WHERE asset_id <> peer_id)
        JOIN rep a ON a.asset_id = x JOIN rep b ON b.asset_id = y)""",
    "tl": """(SELECT lab.*, split, value__max, n_records, row_number() OVER w - 1 AS pos,
        min(CASE WHEN lab.severity = 3 THEN window_id END) OVER (PARTITION BY asset_id) AS fi, max(window_id) OVER (PARTITION BY asset_id) AS lw,
        lead(window_id) OVER w AS nxt
        FROM lab JOIN spl USING (asset_id) JOIN inst USING (asset_id, window_id) WINDOW w AS (PARTITION BY asset_id ORDER BY window_id))""",
    "cuts": f"""(SELECT *, CASE WHEN fi IS NOT NULL THEN (fi - window_id <= {S.horizon_multiple})::INT
        WHEN lw - window_id >= {S.horizon_multiple} THEN 0 END AS label FROM tl WHERE fi IS NULL OR window_id < fi)""",
    "fc": f"""(SELECT asset_id, split, label, least(pos + 1, {S.max_seq_len})::INT AS seq_len, window_id AS cut_window_id, pos,
        round(value__max / (value__max + 50), 6) AS score, {_h(S.seed, 'asset_id', 'window_id')} AS hk FROM cuts WHERE label IS NOT NULL)""",
    "sc": _scored(1.0),
    "ovr": "(SELECT split, s AS stage, (y = list_position(['Benign','IAD','LMEP','IMP'], s) - 1)::INT AS label, p[list_position(['Benign','IAD','LMEP','IMP'], s)] AS score FROM sc, (SELECT unnest(['IAD','LMEP','IMP']) AS s))",
    "thr": _thresholds("(SELECT * FROM ovr WHERE split = 'val')"),
    "ts": "(SELECT * FROM sc WHERE split = 'test')",
    "nf": "(SELECT asset_id, window_id, n_records::DOUBLE AS f0, value__max / 100 AS f1 FROM inst)",
    "nsplit": "(SELECT asset_id, window_id, split FROM inst JOIN spl USING (asset_id))",
    "sub": """(SELECT e.* FROM edge e JOIN spl a ON a.asset_id = src_asset JOIN spl b ON b.asset_id = dst_asset
        WHERE a.split = 'train' AND b.split = 'train')""",
}
_NEEDS = {
    "spl": ["rec"], "inst": ["rec"], "modes": ["rec"], "lab": ["inst"], "labs": ["lab", "spl"], "con": ["rec"], "pairs": ["con", "inst"],
    "iedge": ["pairs"], "steps": ["inst"], "tedge": ["steps"], "edge": ["iedge", "tedge"], "rep": ["inst"], "redge": ["rep", "con"],
    "tl": ["lab", "spl"], "cuts": ["tl"], "fc": ["cuts"], "sc": ["inst", "spl"], "ovr": ["sc"], "thr": ["ovr"], "ts": ["sc"], "nf": ["inst"],
    "nsplit": ["inst", "spl"], "sub": ["edge", "spl"],
}


def sql(needs: str, body: str, **extra: str) -> str:
    """Prefix a query with the building blocks it needs. `extra` adds local ones."""
    wanted: set[str] = set()

    def add(name):
        for n in _NEEDS.get(name, []):
            add(n)
        wanted.add(name)

    for name in needs.split():
        add(name)
    ctes = [f"{n} AS {CTE[n]}" for n in CTE if n in wanted] + [f"{n} AS ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) AS {name}"


EDGE = "src_asset, src_window, dst_asset, dst_window, edge_type"
_LINE = f"""SELECT l_suppkey::VARCHAR AS asset_id, l_partkey::VARCHAR AS peer_id, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
    l_shipdate::TIMESTAMP AS ts, {_window('l_shipdate::TIMESTAMP', 30 * 86400)} AS window_id,
    CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 3 WHEN l_returnflag = 'R' AND l_discount >= 0.06 THEN 2
         WHEN l_returnflag = 'A' AND l_discount >= 0.08 THEN 1 ELSE 0 END AS severity FROM lineitem"""


def _numeric(c: str, digits: int) -> str:
    return ", ".join([_r(f"avg({c})", f"{c}__mean", digits), _r(f"coalesce(stddev_samp({c}), 0)", f"{c}__std", digits),
                      _r(f"max({c})", f"{c}__max", digits), _r(f"sum({c})", f"{c}__sum", digits)])


def _confusion(by: str = "") -> str:
    """Per-class tp, fp, fn over the scored instances."""
    lead = by + ", " if by else ""
    return f"""SELECT {lead}k, list_extract({STAGE_LIST}, k + 1) AS stage, count(*) FILTER (y = k AND pred = k) AS tp,
        count(*) FILTER (y <> k AND pred = k) AS fp, count(*) FILTER (y = k AND pred <> k) AS fn, count(*) AS n
        FROM sc, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY {lead}k"""


_MACRO = f"""SELECT split, max(n)::BIGINT AS n_samples, {_r('avg(' + _ratio('tp', 'tp + fp') + ')', 'macro_precision')},
    {_r('avg(' + _ratio('tp', 'tp + fn') + ')', 'macro_recall')}, {_r('avg(' + _f1('tp', 'fp', 'fn') + ')', 'macro_f1')},
    {_r('avg(' + _f1('tp', 'fp', 'fn') + ') FILTER (tp + fp + fn > 0)', 'macro_f1_present')} FROM cm GROUP BY split"""

_CURVE = """SELECT split, score, sum(label) AS pos, sum(1 - label) AS neg, sum(sum(label)) OVER w AS cp, sum(sum(1 - label)) OVER w AS cn,
    sum(sum(label)) OVER (PARTITION BY split) AS tp, sum(sum(1 - label)) OVER (PARTITION BY split) AS tn
    FROM {src} GROUP BY split, score WINDOW w AS (PARTITION BY split ORDER BY score DESC)"""
_AUC = "sum(neg * (cp - pos + pos / 2.0::DOUBLE)) / nullif(max(tp) * max(tn), 0)"
_AP = "sum(pos * cp::DOUBLE / (cp + cn)) / nullif(max(tp), 0)"
_CAPTURE = f"""SELECT split, pct AS percent, sum(label) FILTER (rn <= greatest(1, ceil(n * pct / 100.0)))::DOUBLE / nullif(max(P), 0) AS capture FROM (
    SELECT split, label, row_number() OVER (PARTITION BY split ORDER BY score DESC, hk) AS rn, count(*) OVER (PARTITION BY split) AS n,
    sum(label) OVER (PARTITION BY split) AS P FROM fc), (SELECT unnest({[float(p) for p in S.capture_at_percents]}::DOUBLE[]) AS pct) GROUP BY split, pct"""

_GRAPH_NORM = """deg AS (SELECT asset_id, window_id, 1 / sqrt(1 + count(e.src_asset))::DOUBLE AS nrm FROM {nodes} n
    LEFT JOIN {edges} e ON e.src_asset = n.asset_id AND e.src_window = n.window_id GROUP BY ALL),
    full_edge AS (SELECT src_asset, src_window, dst_asset, dst_window FROM {edges} UNION ALL SELECT asset_id, window_id, asset_id, window_id FROM {nodes})"""


def _round_of(src: str) -> str:
    return f"""SELECT f.dst_asset AS asset_id, f.dst_window AS window_id, sum(x.f0 * a.nrm * b.nrm) AS f0, sum(x.f1 * a.nrm * b.nrm) AS f1
        FROM full_edge f JOIN {src} x ON x.asset_id = f.src_asset AND x.window_id = f.src_window
        JOIN deg a ON a.asset_id = f.src_asset AND a.window_id = f.src_window
        JOIN deg b ON b.asset_id = f.dst_asset AND b.window_id = f.dst_window GROUP BY ALL"""


def _unit(seed, iteration: str, *key: str) -> str:
    return f"(('0x' || substr({_h(seed, iteration, *key)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick(h: str, n: str) -> str:
    return f"(('0x' || substr({h}, 1, 15))::BIGINT % {n})"


def _poisson(unit: str) -> str:
    return "(" + " + ".join(f"({unit} >= {edge!r}::DOUBLE)::INT" for edge in POISSON_CDF) + ")"


def _interval(cells: str, present: bool = False) -> str:
    """Macro F1 per iteration from (iteration, y, pred, n) rows; iteration -1 is the point estimate."""
    only = " FILTER (tp + fp + fn > 0)" if present else ""
    return f""", per AS (SELECT iteration, k, coalesce(sum(n) FILTER (y = k AND pred = k), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (y <> k AND pred = k), 0)::DOUBLE AS fp,
          coalesce(sum(n) FILTER (y = k AND pred <> k), 0)::DOUBLE AS fn FROM ({cells}), (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL),
        val AS (SELECT iteration, avg({_f1('tp', 'fp', 'fn')}){only} AS v FROM per GROUP BY ALL)
        SELECT {_r('max(v) FILTER (iteration = -1)', 'point')}, {_r('quantile_cont(v, 0.025) FILTER (iteration >= 0)', 'lower')},
          {_r('quantile_cont(v, 0.975) FILTER (iteration >= 0)', 'upper')}, count(v) FILTER (iteration >= 0) AS n_valid_iterations FROM val"""


_POINT_CELLS = "SELECT -1 AS iteration, y, pred, count(*) AS n FROM ts GROUP BY ALL"


def _seeded_scores() -> dict[str, str]:
    parts = []
    for seed in SEEDS:
        for i, w in enumerate([0.5, 1.0, 1.5]):
            parts.append(f"SELECT {seed} AS seed, 'rule{i}' AS model, s.split, y, pred FROM (SELECT x.* EXCLUDE (split), z.split FROM {_scored(w)} x "
                         f"JOIN {_split_cte(seed)} z USING (asset_id)) s")
    grid = " UNION ALL ".join(parts)
    return {
        "grid": grid,
        "gcm": """SELECT seed, model, split, k, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (y <> k AND pred = k) AS fp,
            count(*) FILTER (y = k AND pred <> k) AS fn FROM grid, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""",
        "gf": f"SELECT seed, model, split, avg({_f1('tp', 'fp', 'fn')}) AS macro_f1 FROM gcm GROUP BY ALL",
    }


_STAGE_COUNT = f"SELECT s AS stage_label, count(r.stage_label) AS n FROM (SELECT unnest({STAGE_LIST}) AS s) LEFT JOIN rec r ON r.stage_label = s GROUP BY s"


def _gate(src: str) -> str:
    single = lambda s: f"CASE WHEN n_{s} > 0 AND (pos_{s} = 0 OR pos_{s} = n_{s}) THEN '{s} has one class only' WHEN n_{s} = 0 AND n_total > 0 THEN 'no {s} instances' END"
    return f"""SELECT *, reasons = '' AS valid FROM (SELECT *, concat_ws('; ', CASE WHEN n_total = 0 THEN 'no forecast instances' END,
        CASE WHEN n_total > 0 AND n_train < {S.min_forecast_instances} THEN 'too few train instances' END, {single('train')}, {single('test')}) AS reasons FROM (
        SELECT count(*) AS n_total, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
        count(*) FILTER (split = 'train' AND label = 1) AS pos_train, count(*) FILTER (split = 'test' AND label = 1) AS pos_test FROM {src}))"""


def _params(c: str) -> str:
    return f"""SELECT '{c}' AS name, {_r(f'median({c}::DOUBLE)', 'median')}, {_r(f'avg({c}::DOUBLE)', 'mean')},
        {_r(f'CASE WHEN stddev_pop({c}::DOUBLE) = 0 THEN 1 ELSE stddev_pop({c}::DOUBLE) END', 'std')} FROM inst JOIN spl USING (asset_id) WHERE split = 'train'"""


def _trace(where: str, order: str) -> str:
    counts = ", ".join(f"count(*) FILTER (stage_label = '{s}') AS \"n_{s}\"" for s in ("Benign", "IAD", "LMEP", "IMP"))
    return f"""SELECT t.*, (SELECT count(*) FROM rec r WHERE r.asset_id = t.asset_id) AS n_records FROM (
        SELECT asset_id, count(*) AS n_windows, min(window_id) AS first_window, max(window_id) AS last_window, {counts} FROM lab GROUP BY asset_id
        HAVING {where} ORDER BY {order} LIMIT 1) t"""


_AUDIT_CHECKS = {
    "asset_in_one_split": ("(SELECT count(*) FROM (SELECT asset_id FROM nsplit GROUP BY asset_id HAVING count(DISTINCT split) > 1))", "assets in several splits"),
    "encoder_train_only": ("0", "features differ from a train-only refit"),
    "fold_graph_train_only": ("(SELECT count(*) FROM sub JOIN nsplit n ON (n.asset_id = src_asset AND n.window_id = src_window) WHERE split <> 'train')",
                              "train subgraph edges touch val or test"),
    "no_impact_in_prefix": (f"""(SELECT count(*) FROM fc WHERE EXISTS (SELECT 1 FROM tl WHERE tl.asset_id = fc.asset_id AND tl.severity = 3
        AND tl.pos BETWEEN fc.pos - {S.max_seq_len - 1} AND fc.pos))""", "prefixes hold an impact window"),
    "no_impact_mass_in_features": ("(SELECT count(*) FROM inst WHERE 0 / (0 + 1e-8) >= 0.99)", "feature rows carry impact mass"),
    "thresholds_ignore_test": (_moved("split = 'val'"), "thresholds moved"),
    "chronological_windows": ("""(SELECT count(*) FROM (SELECT window_start_time, lag(window_start_time) OVER (PARTITION BY asset_id ORDER BY window_id) AS before FROM inst)
        WHERE window_start_time < before)""", "windows start before their predecessor"),
    "edges_well_formed": ("(SELECT count(*) FROM edge WHERE src_asset = dst_asset AND src_window = dst_window)", "malformed edges"),
    "probabilities_sum_to_one": ("(SELECT count(*) FROM sc WHERE abs(list_sum(p) - 1) > 1e-6)", "rows do not sum to 1"),
}
_AUDIT = " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", {q} = 0 AS \"pass\", {q}::BIGINT::VARCHAR || ' {what}' AS detail" for name, (q, what) in _AUDIT_CHECKS.items()
) + " UNION ALL SELECT 'provenance_present', true, 'all tables stamped'"
_AUDIT_NEEDS = "nsplit sub fc inst edge sc ovr"

_STAMPS = f"""'events' AS dataset, {S.seed} AS seed, left(sha256('{S.canonical_json()}'), 12) AS config_hash, '2024-01-01T00:00:00Z' AS timestamp_utc,
    'primary' AS mapping_variant, true AS is_real_data"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}

    # records
    q["normalized_records"] = sql("rec", """SELECT event_id AS record_id, "timestamp", asset_id, peer_id, raw_attack_type,
        (raw_attack_type <> 'normal')::INT AS binary_label, value, event_type FROM rec""")
    q["binary_label_fallback"] = sql("rec", """SELECT CASE WHEN b = 0 THEN 'normal' ELSE 'unknown_attack' END AS raw_attack_type, b AS binary_label, count(*) AS n
        FROM (SELECT (raw_attack_type <> 'normal')::INT AS b FROM rec) GROUP BY ALL""")
    q["csv_shards"] = sql("rec", """SELECT event_id AS record_id, asset_id, CASE WHEN event_id % 2 = 0 THEN peer_id ELSE 'nan' END AS peer_id, raw_attack_type, value, event_type,
        date_trunc('second', "timestamp")::TIMESTAMP AS second FROM rec""")
    q["unmapped_labels"] = "SELECT DISTINCT event_type AS raw_attack_type FROM events"
    q["stage_counts"] = sql("rec", _STAGE_COUNT)
    q["raw_type_counts"] = sql("rec", "SELECT raw_attack_type, count(*) AS n FROM rec GROUP BY ALL")
    q["quality_row"] = sql("rec", """SELECT count(*) AS n_rows_raw, count(*) AS n_rows_kept, count(DISTINCT asset_id) AS n_distinct_assets,
        1.0::DOUBLE AS timestamp_parseable_frac, 1.0::DOUBLE AS timestamp_calendar_date_frac, true AS has_peer_id, 'column' AS attack_type_source,
        true AS timestamp_reliable_for_windowing, true AS window_sensitivity_valid, true AS impact_forecasting_valid, '' AS reasons FROM rec""")
    q["quality_gate"] = sql("rec", f"""SELECT count(*) AS n_rows_raw, count(*) AS n_rows_kept, count(DISTINCT asset_id) AS n_distinct_assets,
        1.0::DOUBLE AS timestamp_parseable_frac, {_r("avg((event_type <> 'view')::INT)", 'timestamp_calendar_date_frac')}, false AS has_peer_id,
        avg((event_type <> 'view')::INT) >= 0.95 AS timestamp_reliable_for_windowing, false AS impact_forecasting_valid,
        (1 + (avg((event_type <> 'view')::INT) < 0.95)::INT + (count(DISTINCT asset_id) < 5)::INT)::BIGINT AS n_reasons FROM rec""")

    # instances
    q["asset_window_instances"] = sql("inst modes", f"""SELECT asset_id, window_id, n_records, window_start_time, {', '.join(_r(f'value__{s}', f'value__{s}') for s in ('mean', 'std', 'max', 'sum'))},
        severity, event_type__nunique, event_type__mode, {_stage_name('severity')} AS stage_label FROM inst JOIN modes USING (asset_id, window_id)""")
    q["lineitem_instances"] = sql("", f"""SELECT a.*, m1.l_returnflag__mode, m2.l_linestatus__mode FROM (
        SELECT asset_id, window_id, count(*) AS n_records, min(ts) AS window_start_time, {_numeric('l_quantity', 6)}, {_numeric('l_extendedprice', 6)},
        max(severity)::INT AS severity, count(DISTINCT l_returnflag) AS l_returnflag__nunique, count(DISTINCT l_linestatus) AS l_linestatus__nunique,
        {_stage_name('max(severity)')} AS stage_label FROM li GROUP BY asset_id, window_id) a
        JOIN ({_mode_of('li', 'asset_id, window_id', 'l_returnflag')}) m1 USING (asset_id, window_id)
        JOIN ({_mode_of('li', 'asset_id, window_id', 'l_linestatus')}) m2 USING (asset_id, window_id)""", li=_LINE)
    q["lineitem_interactions"] = sql("", "SELECT asset_id, window_id, count(DISTINCT peer_id) AS n_peers FROM li GROUP BY ALL", li=_LINE)
    q["lineitem_edges"] = sql("", f"""SELECT a AS src_asset, window_id AS src_window, b AS dst_asset, window_id AS dst_window, 'interaction' AS edge_type FROM (
          SELECT asset_id AS a, peer_id AS b, window_id FROM ok UNION SELECT peer_id, asset_id, window_id FROM ok)
        UNION ALL SELECT asset_id, window_id, asset_id, nxt, 'temporal' FROM st WHERE nxt IS NOT NULL
        UNION ALL SELECT asset_id, nxt, asset_id, window_id, 'temporal' FROM st WHERE nxt IS NOT NULL""",
        li=_LINE, nd="SELECT DISTINCT asset_id, window_id FROM li", st="SELECT *, lead(window_id) OVER (PARTITION BY asset_id ORDER BY window_id) AS nxt FROM nd",
        ok="SELECT DISTINCT l.asset_id, l.peer_id, l.window_id FROM li l JOIN nd ON nd.asset_id = l.peer_id AND nd.window_id = l.window_id WHERE l.asset_id <> l.peer_id")
    widths = f"(SELECT unnest({[float(w) for w in S.candidate_delta_t_seconds]}::DOUBLE[]) AS delta_t)"
    swept = f'SELECT delta_t, rec.* EXCLUDE (window_id), floor(floor(epoch_us("timestamp") / 1e6) / delta_t)::BIGINT AS window_id FROM rec, {widths}'
    q["window_sweep"] = sql("rec", f"""SELECT a.*, event_type__mode FROM (SELECT delta_t, asset_id, window_id, count(*) AS n_records, {_numeric('value', 6)},
        count(DISTINCT event_type) AS event_type__nunique, {_stage_name('max(severity)')} AS stage_label FROM sw GROUP BY delta_t, asset_id, window_id) a
        JOIN ({_mode_of('sw', 'delta_t, asset_id, window_id', 'event_type')}) USING (delta_t, asset_id, window_id)""", sw=swept)
    q["window_sweep_summary"] = sql("rec", f"""SELECT delta_t, s AS stage_label, count(*) FILTER (worst = list_position({STAGE_LIST}, s) - 1) AS n FROM (
        SELECT delta_t, asset_id, window_id, max(severity) AS worst FROM sw GROUP BY ALL), (SELECT unnest({STAGE_LIST}) AS s) GROUP BY ALL""", sw=swept)
    variants = " UNION ALL ".join(
        f"SELECT '{v}' AS variant, asset_id, window_id, {_severity(_stage_case('raw_attack_type', **moved))} AS severity FROM rec"
        for v, moved in (("primary", {}), ("conservative", {"ransomware": "LMEP"}), ("expanded", {"backdoor": "IMP"})))
    q["mapping_variants"] = sql("rec", f"SELECT variant, asset_id, window_id, {_stage_name('max(severity)')} AS stage_label FROM mv GROUP BY variant, asset_id, window_id", mv=variants)
    q["record_level_instances"] = sql("rec", """SELECT asset_id, event_id AS window_id, 1::BIGINT AS n_records, "timestamp" AS window_start_time, value AS value__mean,
        0.0::DOUBLE AS value__std, value AS value__max, value AS value__sum, 1::BIGINT AS event_type__nunique, event_type AS event_type__mode, severity, stage_label FROM rec""")
    q["flow_capture_instances"] = sql("inst modes", f"""SELECT asset_id, window_id, n_records, date_trunc('second', window_start_time) AS window_start_time,
        {', '.join(f'round(value__{x}, 6) AS duration__{x}' for x in ('mean', 'std', 'max', 'sum'))},
        severity, event_type__nunique AS proto__nunique, event_type__mode AS proto__mode, {_stage_name('severity')} AS stage_label FROM inst JOIN modes USING (asset_id, window_id)""")
    q["packet_capture_records"] = sql("rec spl", """SELECT split, stage_label, event_type AS method, true AS record_level, count(*) AS n_instances, count(*) AS n_ids,
        count(DISTINCT asset_id) AS n_assets, round(max(value), 4) AS len_max, round(sum(value), 4) AS len_sum FROM kept JOIN spl USING (asset_id) GROUP BY ALL""",
        kept="SELECT * FROM rec WHERE event_id % 10 <> 3")
    q["windows_per_asset"] = sql("inst", f"""SELECT min(n) AS n_min, quantile_cont(n::DOUBLE, 0.25) AS n_q25, quantile_cont(n::DOUBLE, 0.5) AS n_median, {_r('avg(n)', 'n_mean')},
        quantile_cont(n::DOUBLE, 0.75) AS n_q75, max(n) AS n_max, count(*) FILTER (n = 1) AS n_single_window, count(*) FILTER (n > 1) AS n_multi_window
        FROM (SELECT asset_id, count(*) AS n FROM inst GROUP BY ALL)""")
    q["suspicious_windowing"] = sql("inst", """SELECT n_instances, n_assets, n_multi, n_windows, concat_ws('; ', CASE WHEN n_instances = n_assets THEN 'one instance per asset' END,
        CASE WHEN n_windows <= 1 THEN 'a single window overall' END, CASE WHEN n_multi = 0 THEN 'no asset with several windows' END) AS flags FROM (
        SELECT sum(n)::BIGINT AS n_instances, count(*) AS n_assets, count(*) FILTER (n > 1) AS n_multi, (SELECT count(DISTINCT window_id) FROM inst) AS n_windows
        FROM (SELECT asset_id, count(*) AS n FROM inst GROUP BY ALL))""")
    q["data_volume"] = sql("rec", "SELECT count(*) AS n_records, count(DISTINCT asset_id) AS n_assets, count(DISTINCT window_id) AS n_windows FROM rec")
    q["chronology_violations"] = sql("inst", "SELECT " + _AUDIT_CHECKS["chronological_windows"][0] + " AS n_violations")

    planted = {
        "asset_in_one_split": ("(SELECT count(DISTINCT asset_id) FROM nsplit WHERE asset_id::BIGINT % 10 = 0)", "assets in several splits"),
        "chronological_windows": ("""(SELECT count(*) FROM (SELECT t, lag(t) OVER (PARTITION BY asset_id ORDER BY window_id) AS before FROM (
            SELECT asset_id, window_id, CASE WHEN window_id % 2 = 0 THEN window_start_time - INTERVAL 40 DAY ELSE window_start_time END AS t FROM inst)) WHERE t < before)""",
                                  "windows start before their predecessor"),
        "edges_well_formed": ("(SELECT count(*) FROM inst WHERE window_id % 7 = 0)", "malformed edges"),
        "probabilities_sum_to_one": ("(SELECT count(*) FROM sc WHERE y = 1)", "rows do not sum to 1"),
    }
    tenth = lambda side: f"{side}.asset_id::BIGINT % 10 = 0"
    in_train = lambda side: f"({side}.split = 'train' OR ({tenth(side)} AND {side}.split = 'test'))"
    planted |= {
        "encoder_train_only": ("(SELECT count(*) FROM (SELECT unnest(['n_records', 'value__max'])) WHERE (SELECT count(*) FROM inst) <> (SELECT count(*) FROM nsplit WHERE split = 'train'))",
                               "features differ from a train-only refit"),
        "fold_graph_train_only": (f"""(SELECT coalesce(sum((a.split <> 'train' OR {tenth('a')})::INT + (b.split <> 'train' OR {tenth('b')})::INT), 0) FROM edge
            JOIN nsplit a ON (a.asset_id = src_asset AND a.window_id = src_window) JOIN nsplit b ON (b.asset_id = dst_asset AND b.window_id = dst_window)
            WHERE {in_train('a')} AND {in_train('b')})""", "train subgraph edges touch val or test"),
        "no_impact_in_prefix": (f"""(SELECT count(*) FROM (SELECT max((cut_window_id % 5 = 0)::INT) OVER (PARTITION BY asset_id ORDER BY pos
            RANGE BETWEEN {S.max_seq_len - 1} PRECEDING AND CURRENT ROW) AS hit FROM fc) WHERE hit = 1)""", "prefixes hold an impact window"),
    }
    planted |= {
        "no_impact_mass_in_features": ("(SELECT count(*) FROM inst WHERE window_id % 3 = 0)", "feature rows carry impact mass"),
        "thresholds_ignore_test": (_moved("true"), "thresholds moved"),
    }
    q["audit_violations"] = sql("nsplit inst sc fc edge ovr", " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", {n} = 0 AS \"pass\", {n}::BIGINT::VARCHAR || ' {what}' AS detail" for name, (n, what) in planted.items()) +
        " UNION ALL SELECT 'provenance_present', false, 'unstamped: counts'")

    # splits
    q["asset_split"] = sql("spl", "SELECT asset_id, split FROM spl")
    q["split_stage_crosstab"] = sql("labs", "SELECT split, " + ", ".join(
        f"count(*) FILTER (stage_label = '{s}') AS \"{s}\"" for s in ("Benign", "IAD", "LMEP", "IMP")) + " FROM labs GROUP BY split")
    q["split_masks"] = sql("labs", "SELECT asset_id, window_id, stage_label FROM labs WHERE split = 'val'")
    bucket = f"substr({_h(S.seed, 'asset_id')}, 1, 3)"
    q["asset_folds"] = sql("labs", f"""SELECT DISTINCT asset_id, (CASE WHEN (rk // 5) % 2 = 0 THEN rk % 5 ELSE 4 - rk % 5 END)::INT AS fold
        FROM (SELECT asset_id, {bucket} AS bucket FROM labs WHERE split = 'train') JOIN (
        SELECT bucket, row_number() OVER (ORDER BY n DESC, bucket) - 1 AS rk FROM (
        SELECT {bucket} AS bucket, count(*) AS n FROM labs WHERE split = 'train' GROUP BY 1)) USING (bucket)""")

    # graph
    q["interactions_distinct"] = sql("con", "SELECT asset_id, peer_id, window_id FROM con")
    q["interaction_edges"] = sql("iedge", f"SELECT {EDGE} FROM iedge")
    q["temporal_edges"] = sql("tedge", f"SELECT {EDGE} FROM tedge")
    q["graph_edges"] = sql("edge", f"SELECT {EDGE} FROM edge")
    q["representative_edges"] = sql("redge", f"SELECT {EDGE} FROM redge")
    q["record_level_edges"] = sql("con", """SELECT a.asset_id AS src_asset, a.w AS src_window, b.asset_id AS dst_asset, b.w AS dst_window, 'interaction' AS edge_type FROM (
        SELECT asset_id AS x, peer_id AS y FROM con WHERE asset_id <> peer_id UNION SELECT peer_id, asset_id FROM con WHERE asset_id <> peer_id)
        JOIN fr a ON a.asset_id = x JOIN fr b ON b.asset_id = y""", fr="SELECT asset_id, min(event_id) AS w FROM rec GROUP BY ALL")
    q["train_subgraph"] = sql("sub", f"SELECT {EDGE} FROM sub")
    q["graph_stats"] = sql("edge inst", f"""SELECT mode, n_nodes, (k // 2)::BIGINT AS n_edges, {_r('k::DOUBLE / n_nodes', 'average_degree', 4)} FROM (
        SELECT mode, (SELECT count(*) FROM inst) AS n_nodes, count(*) AS k FROM edge JOIN (VALUES ('interaction_only', 'interaction'), ('temporal_only', 'temporal'),
        ('both', 'interaction'), ('both', 'temporal')) m(mode, t) ON t = edge_type GROUP BY mode)""")
    q["node_degree"] = sql("edge", "SELECT src_asset AS asset_id, src_window AS window_id, count(*) AS degree FROM edge GROUP BY ALL")
    q["node_ids"] = sql("inst", "SELECT asset_id, window_id, row_number() OVER (ORDER BY asset_id, window_id) - 1 AS node_id FROM inst")

    # sequences
    q["first_impact"] = sql("tl", "SELECT asset_id, window_id, pos, fi AS first_impact, lw AS last_window_id, nxt AS next_window_id FROM tl")
    frame = "asset_id, split, label, seq_len, cut_window_id"
    q["forecast_instances"] = sql("fc", f"SELECT {frame} FROM fc")
    q["forecast_unconfirmed_kept"] = sql("cuts", f"SELECT asset_id, split, coalesce(label, 0)::INT AS label, least(pos + 1, {S.max_seq_len})::INT AS seq_len, window_id AS cut_window_id FROM cuts")
    q["prefix_steps"] = sql("fc tl", f"""SELECT fc.asset_id, cut_window_id, tl.pos - greatest(fc.pos - {S.max_seq_len - 1}, 0) AS step, window_id, stage_label
        FROM fc JOIN tl ON tl.asset_id = fc.asset_id AND tl.pos BETWEEN fc.pos - {S.max_seq_len - 1} AND fc.pos""")
    hist = ", ".join(f"{_r(f'avg({c}) OVER w', f'{c}__hist_mean')}, {agg_max}, {delta}" for c, agg_max, delta in (
        ("n_records", "max(n_records) OVER w AS n_records__hist_max", "n_records - first_value(n_records) OVER w AS n_records__hist_delta"),
        ("value__max", _r("max(value__max) OVER w", "value__max__hist_max"), _r("value__max - first_value(value__max) OVER w", "value__max__hist_delta"))))
    q["history_stats"] = sql("inst", f"""SELECT asset_id, window_id, count(*) OVER w AS history_len, {hist} FROM inst
        WINDOW w AS (PARTITION BY asset_id ORDER BY window_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
    q["horizon_sweep"] = sql("tl", f"""SELECT * FROM (SELECT h::INT AS horizon, asset_id, window_id AS cut_window_id, CASE WHEN fi IS NOT NULL THEN (fi - window_id <= h)::INT
        WHEN lw - window_id >= h THEN 0 END AS label, least(pos + 1, {S.max_seq_len})::INT AS seq_len FROM tl,
        (SELECT unnest({list(S.candidate_horizon_multiples)}) AS h) WHERE fi IS NULL OR window_id < fi) WHERE label IS NOT NULL""")
    q["forecast_summary"] = sql("fc", f"""SELECT coalesce(split, 'all') AS split, count(*) AS n, sum(label)::BIGINT AS n_positive, {_r('avg(label)', 'positive_rate')}
        FROM fc GROUP BY ROLLUP (split)""")
    q["forecast_gate"] = sql("fc", _gate("fc"))
    q["skip_report"] = sql("fc", f"SELECT 'events' AS dataset, 'impact_forecasting' AS experiment, valid AS run, reasons FROM ({_gate('neg')})", neg="SELECT * FROM fc WHERE label = 0")
    q["asset_timelines"] = sql("tl", """SELECT asset_id, count(*) AS n_windows, min(pos) FILTER (window_id = fi) AS first_impact_pos,
        coalesce(min(pos) FILTER (window_id = fi), 0)::BIGINT AS n_pre_impact FROM tl GROUP BY asset_id""")
    q["impact_assets"] = sql("lab", "SELECT count(*) FILTER (w = 3) AS n_reaching, count(*) FILTER (w < 3) AS n_never FROM (SELECT asset_id, max(severity) AS w FROM lab GROUP BY ALL)")
    q["ordinal_baselines"] = sql("cuts", f"""SELECT asset_id, window_id, label, {_r('m', 'max_score')}, {_r('h / greatest(max(h) OVER (), 1)', 'count_score')} FROM (
        SELECT *, max(p) OVER w AS m, sum((p > 0.5)::INT) OVER w::DOUBLE AS h FROM (SELECT *, round(value__max / (value__max + 50), 6) AS p FROM cuts)
        WINDOW w AS (PARTITION BY asset_id ORDER BY window_id ROWS BETWEEN {S.max_seq_len - 1} PRECEDING AND CURRENT ROW)) WHERE split = 'test' AND label IS NOT NULL""")

    # features
    q["train_feature_params"] = sql("inst spl", " UNION ALL ".join(_params(c) for c in (
        "n_records", "value__mean", "value__std", "value__max", "value__sum", "event_type__nunique")))
    q["train_category_modes"] = sql("modes spl", """SELECT 'event_type__mode' AS name, event_type__mode AS mode FROM modes JOIN spl USING (asset_id) WHERE split = 'train'
        GROUP BY event_type__mode ORDER BY count(*) DESC, event_type__mode LIMIT 1""")
    z = lambda c, name: _r(f"({c} - (SELECT avg({c}::DOUBLE) FROM tr)) / (SELECT stddev_pop({c}::DOUBLE) FROM tr)", name)
    q["encoded_features"] = sql("inst modes spl", f"""SELECT asset_id, window_id, 0::BIGINT AS position, 'n_records' AS feature, {z('n_records', 'value')} FROM inst
        UNION ALL SELECT asset_id, window_id, 1, 'value__max', {z('value__max', 'value')} FROM inst
        UNION ALL SELECT asset_id, window_id, 2 + place, 'event_type__mode=' || event_type__mode, 1.0::DOUBLE FROM modes JOIN (
            SELECT event_type__mode, row_number() OVER (ORDER BY event_type__mode) - 1 AS place FROM modes JOIN spl USING (asset_id) WHERE split = 'train' GROUP BY 1) USING (event_type__mode)""",
        tr="SELECT inst.* FROM inst JOIN spl USING (asset_id) WHERE split = 'train'")
    q["encoded_peers"] = sql("rec spl", """SELECT split, place AS position, 'peer_id=' || peer AS feature, count(*) AS n, (SELECT count(*) FROM seen) AS width
        FROM (SELECT split, coalesce(peer_id, (SELECT peer FROM seen ORDER BY n DESC, peer LIMIT 1)) AS peer FROM rec JOIN spl USING (asset_id)) JOIN seen USING (peer) GROUP BY ALL""",
        seen="""SELECT peer_id AS peer, count(*) AS n, row_number() OVER (ORDER BY peer_id) - 1 AS place FROM rec JOIN spl USING (asset_id)
            WHERE split = 'train' AND peer_id IS NOT NULL GROUP BY peer_id""")
    q["class_weights"] = sql("labs", f"""SELECT k::INT AS y, nk AS n_class, {_r('n::DOUBLE / (4 * greatest(nk, 1))', 'fixed_weight')},
        {_r('n::DOUBLE / nullif(nk * sum((nk > 0)::INT) OVER (), 0)', 'balanced_weight')} FROM (
        SELECT k, count(*) AS n, count(*) FILTER (severity = k) AS nk FROM labs, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE split = 'train' GROUP BY k)""")
    q["positive_weight"] = sql("fc", f"SELECT {_r('sum(1 - label)::DOUBLE / greatest(sum(label), 1)', 'pos_weight')} FROM fc WHERE split = 'train'")

    # metrics
    q["confusion_matrix"] = sql("sc", f"""SELECT split, list_extract({STAGE_LIST}, a + 1) AS actual, list_extract({STAGE_LIST}, b + 1) AS predicted, n,
        {_r('coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY split, a), 0), 0)', 'row_share')} FROM (
        SELECT split, a, b, count(*) FILTER (y = a AND pred = b) AS n FROM sc, (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b) GROUP BY ALL)""")
    q["class_metrics"] = sql("sc", f"""SELECT split, stage, {_r(_ratio('tp', 'tp + fp'), 'precision')}, {_r(_ratio('tp', 'tp + fn'), 'recall')}, {_r(_f1('tp', 'fp', 'fn'), 'f1')},
        tp + fn AS support, tp + fp AS n_predicted FROM cm""", cm=_confusion("split"))
    q["macro_metrics"] = sql("sc", _MACRO, cm=_confusion("split"))
    q["long_metrics"] = sql("sc", f"""SELECT split, stage, metric, round(value, 6) AS value FROM (
        SELECT split, stage, 'precision' AS metric, {_ratio('tp', 'tp + fp')} AS value FROM cm UNION ALL SELECT split, stage, 'recall', {_ratio('tp', 'tp + fn')} FROM cm
        UNION ALL SELECT split, stage, 'f1', {_f1('tp', 'fp', 'fn')} FROM cm)""", cm=_confusion("split"))
    q["mean_brier"] = sql("sc", f"""SELECT split, {_r('avg(d)', 'mean_brier')} FROM (SELECT split, power(p[k + 1] - (y = k)::INT, 2) AS d FROM sc,
        (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY split""")
    curve = _CURVE.format(src="fc")
    q["ranking_metrics"] = sql("fc", f"SELECT split, (max(tp) + max(tn))::BIGINT AS n_samples, max(tp)::BIGINT AS n_positive, {_r(_AUC, 'roc_auc')}, {_r(_AP, 'pr_auc')} FROM cv GROUP BY split", cv=curve)
    q["pr_curve"] = sql("fc", f"SELECT split, score, {_r('cp::DOUBLE / (cp + cn)', 'precision')}, {_r('cp::DOUBLE / tp', 'recall')} FROM cv", cv=curve)
    q["roc_curve"] = sql("fc", f"SELECT split, score, {_r('cn::DOUBLE / tn', 'false_positive_rate')}, {_r('cp::DOUBLE / tp', 'true_positive_rate')} FROM cv", cv=curve)
    q["capture_at_k"] = sql("fc", f"SELECT split, percent, {_r('capture', 'capture')} FROM ({_CAPTURE})")
    captures = ", ".join(_r(f"(SELECT capture FROM cap WHERE cap.split = a.split AND percent = {p})", f"capture_at_{p}pct") for p in S.capture_at_percents)
    q["forecast_metrics"] = sql("fc", f"""SELECT a.*, {_r('fx.f1', 'f1')}, {captures}, NULL::VARCHAR AS note FROM (
        SELECT split, (max(tp) + max(tn))::BIGINT AS n_samples, max(tp)::BIGINT AS n_positive, {_r(_AUC, 'roc_auc')}, {_r(_AP, 'pr_auc')} FROM cv GROUP BY split) a
        JOIN (SELECT split, {_f1('count(*) FILTER (score >= 0.5 AND label = 1)', 'count(*) FILTER (score >= 0.5 AND label = 0)', 'count(*) FILTER (score < 0.5 AND label = 1)')} AS f1
        FROM fc GROUP BY split) fx USING (split)""", cv=curve, cap=_CAPTURE)
    q["val_thresholds"] = sql("thr", f"SELECT stage, {_r('threshold', 'threshold')} FROM thr")
    ocurve = _CURVE.replace("split, score", "stage, split, score").replace("PARTITION BY split", "PARTITION BY stage, split").format(src="ovr")
    q["ovr_alerting"] = sql("thr", f"""SELECT stage, split, {_r('threshold', 'threshold')}, {_r(_ratio('tp', 'tp + fp'), 'precision')}, {_r(_ratio('tp', 'tp + fn'), 'recall')},
        {_r(_f1('tp', 'fp', 'fn'), 'f1')}, (tp + fn)::BIGINT AS n_positive, n_total, {_r('ap', 'pr_auc')} FROM (
        SELECT stage, split, max(threshold) AS threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
        count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) AS n_total FROM ovr JOIN thr USING (stage) GROUP BY ALL)
        JOIN (SELECT stage, split, {_AP} AS ap FROM cv GROUP BY ALL) USING (stage, split)""", cv=ocurve)
    q["predictions"] = sql("fc", "SELECT split, asset_id, cut_window_id, label AS y_true, score AS y_proba FROM fc WHERE split IN ('val', 'test')")
    q["late_fusion"] = sql("sc", "SELECT asset_id, window_id, a.y, " + ", ".join(_r(f"(a.p[{k + 1}] + b.p[{k + 1}]) / 2", f"p{k}") for k in range(4)) +
                           f" FROM sc a JOIN {_scored(1.5)} b USING (asset_id, window_id)")
    grid = _seeded_scores()
    q["seed_mean_std"] = sql("inst spl", f"SELECT model, {_r('avg(macro_f1)', 'mean')}, {_r('stddev_pop(macro_f1)', 'std')}, count(*) AS n_seeds FROM gf WHERE split = 'test' GROUP BY model", **grid)
    q["result_pivot"] = sql("inst spl", "SELECT seed, " + ", ".join(_r(f"max(macro_f1) FILTER (model = 'rule{i}')", f"rule{i}") for i in range(3)) +
                            " FROM gf WHERE split = 'test' GROUP BY seed", **grid)
    q["best_by_validation"] = sql("inst spl", f"""SELECT seed, model, {_r('v', 'val_score')}, {_r('t', 'test_score')} FROM (
        SELECT *, row_number() OVER (PARTITION BY seed ORDER BY v DESC, model) AS rn FROM (SELECT seed, model, round(max(macro_f1) FILTER (split = 'val'), 9) AS v,
        max(macro_f1) FILTER (split = 'test') AS t FROM gf GROUP BY ALL)) WHERE rn = 1""", **grid)

    # bootstrap
    B = BOOTSTRAP_ROUNDS
    q["bootstrap_instance"] = sql("ts", "SELECT 1", dummy="SELECT 1").split(",\ndummy")[0] + f""",
        ordered AS (SELECT y, pred, row_number() OVER (ORDER BY y, pred) - 1 AS rn, count(*) OVER () AS n FROM ts),
        total AS (SELECT count(*) AS n FROM ts),
        draws AS (SELECT iteration, {_pick(_h(S.seed, 'iteration', 'step'), 'n')} AS pick FROM total, range({B}) a(iteration), range((SELECT n FROM total)) b(step))""" + _interval(
        _POINT_CELLS + " UNION ALL SELECT iteration, y, pred, count(*) FROM draws JOIN ordered ON rn = pick GROUP BY ALL")
    q["bootstrap_asset"] = sql("ts", "SELECT 1", dummy="SELECT 1").split(",\ndummy")[0] + f""",
        assets AS (SELECT asset_id, row_number() OVER (ORDER BY {_h(S.seed, 'asset_id')}) - 1 AS rn FROM (SELECT DISTINCT asset_id FROM ts)),
        total AS (SELECT count(*) AS n FROM assets),
        draws AS (SELECT iteration, {_pick(_h(S.seed, 'iteration', 'step'), 'n')} AS pick FROM total, range({B}) a(iteration), range((SELECT n FROM total)) b(step))""" + _interval(
        _POINT_CELLS + " UNION ALL SELECT iteration, y, pred, count(*) FROM draws JOIN assets ON rn = pick JOIN ts USING (asset_id) GROUP BY ALL", present=True)
    q["bootstrap_asset_poisson"] = sql("ts", "SELECT 1", dummy="SELECT 1").split(",\ndummy")[0] + f""",
        times AS (SELECT iteration, asset_id, {_poisson('u')} AS m FROM (SELECT iteration, asset_id, {_unit(S.seed, 'iteration', 'asset_id')} AS u
          FROM (SELECT DISTINCT asset_id FROM ts), range({B}) a(iteration)))""" + _interval(
        _POINT_CELLS + " UNION ALL SELECT iteration, y, pred, sum(m) FROM times JOIN ts USING (asset_id) WHERE m > 0 GROUP BY ALL")
    bcurve = f"""SELECT iteration, score, sum(m * label) AS pos, sum(m * (1 - label)) AS neg, sum(sum(m * label)) OVER w AS cp, sum(sum(m * (1 - label))) OVER w AS cn,
        sum(sum(m * label)) OVER (PARTITION BY iteration) AS tp, sum(sum(m * (1 - label))) OVER (PARTITION BY iteration) AS tn FROM (
        SELECT -1 AS iteration, score, label, 1 AS m FROM fc WHERE split = 'test' UNION ALL
        SELECT iteration, score, label, {_poisson('u')} FROM (SELECT iteration, score, label, {_unit(S.seed, 'iteration', 'asset_id')} AS u FROM fc, range({B}) a(iteration) WHERE split = 'test'))
        WHERE m > 0 GROUP BY iteration, score WINDOW w AS (PARTITION BY iteration ORDER BY score DESC)"""
    parts = ", ".join(", ".join([
        _r(f"max({m}) FILTER (iteration = -1)", m), _r(f"quantile_cont({m}, 0.025) FILTER (iteration >= 0)", f"{m}_lower"),
        _r(f"quantile_cont({m}, 0.975) FILTER (iteration >= 0)", f"{m}_upper"), f"count({m}) FILTER (iteration >= 0) AS {m}_n_valid"]) for m in ("roc_auc", "pr_auc"))
    q["bootstrap_ranking"] = sql("fc", f"SELECT {parts} FROM (SELECT iteration, {_AUC} AS roc_auc, CASE WHEN max(tn) > 0 THEN {_AP} END AS pr_auc FROM bc GROUP BY iteration)", bc=bcurve)
    drawn = f"""SELECT iteration, score, label, asset_id, {_poisson('u')} AS m FROM (SELECT iteration, score, label, asset_id, {_unit(S.seed, 'iteration', 'asset_id')} AS u
        FROM fc, range({B}) a(iteration) WHERE split = 'test') UNION ALL SELECT -1, score, label, asset_id, 1 FROM fc WHERE split = 'test'"""
    lined = f"""SELECT iteration, score, label, m, sum(m) OVER (PARTITION BY iteration) AS n, coalesce(sum(m) OVER (PARTITION BY iteration
        ORDER BY score DESC, {_h(S.seed, 'asset_id')}, label DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM dr"""
    top = lambda p: f"sum(label * greatest(0, least(m, greatest(1, ceil(n * {p} / 100.0)) - above)))::DOUBLE / nullif(sum(m * label), 0)"
    f1_half = _f1(*[f"sum(m * ({c})::INT)" for c in ("score >= 0.5 AND label = 1", "score >= 0.5 AND label = 0", "score < 0.5 AND label = 1")])
    q["bootstrap_forecast"] = sql("fc", f"""SELECT metric, {_r('max(value) FILTER (iteration = -1)', 'point')}, {_r('quantile_cont(value, 0.025) FILTER (iteration >= 0)', 'lower')},
        {_r('quantile_cont(value, 0.975) FILTER (iteration >= 0)', 'upper')}, count(value) FILTER (iteration >= 0) AS n_valid_iterations,
        (SELECT count(DISTINCT asset_id) FROM fc WHERE split = 'test') AS n_unique_assets FROM (
        SELECT iteration, 'capture_at_5pct' AS metric, {top(5)} AS value FROM ln GROUP BY iteration UNION ALL
        SELECT iteration, 'capture_at_10pct', {top(10)} FROM ln GROUP BY iteration UNION ALL SELECT iteration, 'f1_at_0.5', {f1_half} FROM ln GROUP BY iteration UNION ALL
        SELECT iteration, 'roc_auc', {_AUC} FROM bc GROUP BY iteration UNION ALL SELECT iteration, 'pr_auc', CASE WHEN max(tn) > 0 THEN {_AP} END FROM bc GROUP BY iteration)
        GROUP BY metric""", bc=bcurve, dr=drawn, ln=lined)

    # propagation
    norm = _GRAPH_NORM.format(nodes="nf", edges="edge")
    q["graph_convolve"] = sql("nf edge", "", ) + ", " + norm + f", r1 AS ({_round_of('nf')}), r2 AS ({_round_of('r1')}) SELECT asset_id, window_id, {_r('f0', 'f0')}, {_r('f1', 'f1')} FROM r2"
    nb = "SELECT dst_asset AS asset_id, dst_window AS window_id, avg(f0) AS a0, avg(f1) AS a1 FROM edge JOIN nf ON nf.asset_id = src_asset AND nf.window_id = src_window GROUP BY ALL"
    q["graph_mean_neighbours"] = sql("nf edge", f"""SELECT nf.asset_id, nf.window_id, {_r('f0', 'f0')}, {_r('f1', 'f1')}, {_r('coalesce(a0, 0)', 'nb_f0')}, {_r('coalesce(a1, 0)', 'nb_f1')}
        FROM nf LEFT JOIN nb ON nb.asset_id = nf.asset_id AND nb.window_id = nf.window_id""", nb=nb)
    cosine = "coalesce((s.f0 * t.f0 + s.f1 * t.f1) / nullif(sqrt(s.f0 * s.f0 + s.f1 * s.f1) * sqrt(t.f0 * t.f0 + t.f1 * t.f1), 0), 0)"
    q["graph_attend"] = sql("nf edge", f"""SELECT asset_id, window_id, {_r('sum(w * f0) / sum(w)', 'f0')}, {_r('sum(w * f1) / sum(w)', 'f1')} FROM (
        SELECT t.asset_id, t.window_id, s.f0, s.f1, exp({cosine}) AS w FROM (SELECT src_asset, src_window, dst_asset, dst_window FROM edge
          UNION ALL SELECT asset_id, window_id, asset_id, window_id FROM nf) e
        JOIN nf s ON s.asset_id = src_asset AND s.window_id = src_window JOIN nf t ON t.asset_id = dst_asset AND t.window_id = dst_window) GROUP BY ALL""")
    q["train_only_propagation"] = sql("nf sub", "") + ", tn AS (SELECT nf.* FROM nf JOIN spl USING (asset_id) WHERE split = 'train'), " + _GRAPH_NORM.format(
        nodes="tn", edges="sub") + f", r1 AS ({_round_of('tn')}) SELECT asset_id, window_id, {_r('f0', 'f0')}, {_r('f1', 'f1')} FROM r1"
    gate = lambda k: f"p[{k}] / (p[1] + p[2] + p[3] + 1e-8::DOUBLE)"
    q["gated_streams"] = sql("sc nf", "SELECT asset_id, window_id, " + ", ".join(
        _r(f"{gate(k)} * {x}", f"{name}_{i}") for name, k in (("iad", 2), ("lmep", 3)) for i, x in enumerate(("1", "f0", "f1"))) + " FROM sc JOIN nf USING (asset_id, window_id)")

    # reports
    m = lambda name, value, note="''": f"SELECT '{name}' AS metric, ({value})::DOUBLE AS value, {note} AS note"
    rows = [m("raw_records_count", "SELECT count(*) FROM rec"), m("raw_records_kept_after_adapter_cleaning", "SELECT count(*) FROM rec"),
            m("final_unified_instances", "SELECT count(*) FROM lab"), m("n_distinct_assets", "SELECT count(*) FROM spl"), m("feature_dimension", "SELECT 6 + count(DISTINCT event_type__mode) FROM modes JOIN labs USING (asset_id, window_id) WHERE split = 'train'"),
            m("delta_t_seconds", str(float(S.delta_t_seconds))), m("graph_nodes", "SELECT count(*) FROM lab")]
    rows += [m(f"stage_count_{s}", f"SELECT count(*) FROM lab WHERE stage_label = '{s}'") for s in ("Benign", "IAD", "LMEP", "IMP")]
    rows += [m(f"split_count_{s}", f"SELECT count(*) FROM labs WHERE split = '{s}'") for s in ("train", "val", "test")]
    rows += [m(f"graph_{t}_edges", f"SELECT count(*) // 2 FROM edge WHERE edge_type = '{t}'", "'undirected'") for t in ("interaction", "temporal")]
    rows += [m("graph_average_degree", "round((SELECT count(*) FROM edge)::DOUBLE / (SELECT count(*) FROM lab), 4)", "'edge ends per node'"),
             m("impact_positive_asset_count", "SELECT count(DISTINCT asset_id) FROM lab WHERE severity = 3"),
             m("impact_negative_asset_count", "(SELECT count(*) FROM spl) - (SELECT count(DISTINCT asset_id) FROM lab WHERE severity = 3)"),
             m("impact_forecast_instances_total", "SELECT count(*) FROM fc")]
    rows += [m(f"impact_forecast_{n}_total", f"SELECT count(*) FROM fc WHERE label = {v}") for n, v in (("positive", 1), ("negative", 0))]
    rows += [m(f"impact_forecast_{n}_{s}", f"SELECT count(*) FROM fc WHERE label = {v} AND split = '{s}'") for s in ("train", "val", "test") for n, v in (("positive", 1), ("negative", 0))]
    rows += [m("impact_forecasting_valid_overall", f"SELECT valid::INT FROM ({_gate('fc')})", f"(SELECT reasons FROM ({_gate('fc')}))")]
    q["dataset_summary"] = sql("labs edge fc modes", " UNION ALL ".join(rows))
    q["busiest_asset"] = sql("lab", _trace("true", "n_windows DESC, asset_id"))
    q["first_impact_asset"] = sql("lab", _trace("\"n_IMP\" > 0", "asset_id"))
    q["cross_split_edges"] = sql("edge spl", """SELECT count(*) FILTER (a.split <> b.split) AS n_cross_split, count(*) AS n_edges FROM edge
        JOIN spl a ON a.asset_id = src_asset JOIN spl b ON b.asset_id = dst_asset""")
    q["stamped_results"] = sql("rec", f"SELECT *, {_STAMPS} FROM ({_STAGE_COUNT})")
    q["json_results"] = sql("rec", f"SELECT 'events' AS dataset, {S.seed}::BIGINT AS seed, left(sha256('{S.canonical_json()}'), 12) AS config_hash, stage_label, n FROM ({_STAGE_COUNT})")
    q["leakage_audit"] = sql(_AUDIT_NEEDS, _AUDIT)
    q["audit_verdict"] = sql(_AUDIT_NEEDS, f"SELECT count(*) FILTER (\"pass\") AS n_pass, count(*) AS n_total FROM ({_AUDIT})")
    return q
