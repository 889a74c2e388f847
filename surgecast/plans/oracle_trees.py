"""Leaf-wise boosting in DuckDB SQL: an oracle that fits the trees itself.

It grows a tree level by level instead of best-first. The leaves that best-first growth
would have split are those of the greatest *path keys*: along the path to a node, the
least gain, then the least gain behind that one, and so on to its own. So a level splits
every node that still stands among the first ``leaves - 1`` keys, and at the end rows
fall back to the last node above them that no split of that set divides. Several models
grow side by side in one recursion.
"""

from __future__ import annotations

STEP = 0.05


def trees_ctes(src: str, out: str, trees: int, min_rows: int, leaves: str = "31") -> list[str]:
    """CTEs that fit each model ``m`` on the rows of ``src (m, id, train, y, v DOUBLE[])``
    marked train and end with ``{out} (m, id, prediction)`` for the others. ``leaves`` is
    SQL of a number, which may speak of ``m``."""
    o = out
    return [
        f"{o}u AS (SELECT m, count(*) AS n, pow(2.0, -(52 - ceil(log2(greatest(abs(min(y)), abs(max(y)), max(y) - min(y), 1e-9) * 2 * count(*))) - 1)) AS unit "
        f"FROM {src} WHERE train GROUP BY m)",
        f"{o}b AS (SELECT m, floor(sum(floor(y / unit + 0.5)) / any_value(n) + 0.5) AS base FROM {src} JOIN {o}u USING (m) WHERE train GROUP BY m)",
        f"{o}f AS (SELECT m, id, train, unnest(v) AS x, generate_subscripts(v, 1) AS f FROM {src})",
        f"{o}s AS (SELECT m, f, list_sort(list(x)) AS xs, max(x) AS top FROM {o}f WHERE train GROUP BY m, f)",
        f"{o}bd AS (SELECT m, f, list_distinct(list_filter(list_transform(range(1, 255), lambda i: xs[ceil(i::DOUBLE / 255 * len(xs))::BIGINT]), lambda t: t < top)) AS bounds "
        f"FROM {o}s)",
        f"{o}x AS (SELECT m, id, list(CAST(len(list_filter(bounds, lambda t: t < x)) AS INTEGER) ORDER BY f) AS bins FROM {o}f JOIN {o}bd USING (m, f) GROUP BY m, id)",
        f"""{o}r(kind, m, id, tree, lvl, node, r, train, bins, nk, feat, bin) USING KEY (kind, m, id) AS (
  SELECT 0, s.m, CAST(s.id AS BIGINT), 0, 0, CAST(0 AS BIGINT), CASE WHEN s.train THEN floor(y / unit + 0.5) ELSE 0.0 END - base, s.train, bins, CAST(NULL AS DOUBLE[]),
    CAST(NULL AS BIGINT), CAST(NULL AS INTEGER) FROM {src} s JOIN {o}x x ON x.m = s.m AND x.id = s.id JOIN {o}u u ON u.m = s.m JOIN {o}b b ON b.m = s.m
  UNION
  (WITH now AS (SELECT m, max(tree) AS tree, max(lvl) AS lvl, {leaves} AS leaves FROM {o}r WHERE kind = 0 GROUP BY m),
    h AS (SELECT m, node, feat, bin, count(*) AS n, sum(r) AS g FROM (SELECT m, node, r, unnest(bins) AS bin, generate_subscripts(bins, 1) AS feat
          FROM {o}r WHERE kind = 0 AND train) GROUP BY m, node, feat, bin),
    c AS (SELECT m, node, feat, bin, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER p AS nt, sum(g) OVER p AS gt FROM h
          WINDOW w AS (PARTITION BY m, node, feat ORDER BY bin), p AS (PARTITION BY m, node, feat)),
    k AS (SELECT m, node, feat, bin, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt AS gain FROM c
          WHERE nl >= {min_rows} AND nt - nl >= {min_rows}),
    best AS (SELECT m, node, arg_max(struct_pack(feat := feat, bin := bin, gain := gain), [gain, -feat, -bin]) AS s FROM k WHERE gain > 0 GROUP BY m, node),
    fresh AS (SELECT b.m, b.node, b.s.feat AS feat, b.s.bin AS bin, list_append(list_filter(coalesce(p.nk, []), lambda e: e >= -b.s.gain), -b.s.gain) AS nk
          FROM best b JOIN now ON now.m = b.m
          LEFT JOIN recurring.{o}r p ON p.kind = 1 AND p.m = b.m AND b.node > 0 AND p.id = (b.node - 1) // 2 AND p.tree = now.tree),
    top AS (SELECT a.m, a.node FROM (SELECT m, node, nk FROM fresh UNION ALL
            SELECT p.m, p.id, p.nk FROM recurring.{o}r p JOIN now ON now.m = p.m AND p.tree = now.tree WHERE p.kind = 1) a JOIN now ON now.m = a.m
          QUALIFY row_number() OVER (PARTITION BY a.m ORDER BY a.nk, a.node) < now.leaves),
    grow AS (SELECT * FROM fresh SEMI JOIN top USING (m, node)),
    done AS (SELECT now.m, now.tree, list(top.node) FILTER (top.node IS NOT NULL) AS split FROM now LEFT JOIN top ON top.m = now.m
          WHERE now.m NOT IN (SELECT m FROM grow) GROUP BY now.m, now.tree),
    fin AS (SELECT p.m, p.id, done.tree, p.r, p.train, p.bins, ((p.node + 1) >> list_max(list_filter(range(0, 60), lambda k: ((p.node + 1) >> k) >= 1
          AND NOT list_contains(coalesce(done.split, []), ((p.node + 1) >> k) - 1)))) AS leaf FROM recurring.{o}r p JOIN done ON done.m = p.m WHERE p.kind = 0),
    upd AS (SELECT m, id, tree + 1 AS tree, train, bins, r - floor({STEP} * sum(r) FILTER (train) OVER (PARTITION BY m, leaf)
          / count(*) FILTER (train) OVER (PARTITION BY m, leaf) + 0.5) AS r FROM fin)
  SELECT 0, s.m, s.id, now.tree, now.lvl + 1, 2 * s.node + CASE WHEN s.bins[g.feat] <= g.bin THEN 1 ELSE 2 END, s.r, s.train, s.bins, NULL, NULL, NULL
    FROM {o}r s JOIN grow g ON g.m = s.m AND g.node = s.node JOIN now ON now.m = s.m WHERE s.kind = 0
  UNION ALL SELECT 1, f.m, f.node, now.tree, now.lvl + 1, 0, 0.0, NULL, NULL, f.nk, f.feat, f.bin FROM fresh f JOIN now ON now.m = f.m WHERE f.m IN (SELECT m FROM grow)
  UNION ALL SELECT CASE WHEN tree < {trees} THEN 0 ELSE 2 END, m, id, tree, 0, 0, r, train, bins, NULL, NULL, NULL FROM upd))""",
        f"{o} AS (SELECT m, id, -r * unit AS prediction FROM {o}r JOIN {o}u USING (m) WHERE kind = 2 AND NOT train)",
    ]


def model_rows(name: str, rows: list[tuple[int, str, str]], keys: list[str], features: tuple[str, ...]) -> list[str]:
    """``{name}`` for ``trees_ctes`` from ``(m, relation, SQL of train)``: the features
    and, with series, the level and spread of each series' training rows, rounded."""
    both = " UNION ALL BY NAME ".join(f"SELECT {m} AS m, {', '.join([*keys, 'TimePeriod', *features])}, y, {train} AS train FROM {rel}" for m, rel, train in rows)
    stats = ["level", "spread"] if keys else []
    on = " AND ".join(["a.m = t.m", *(f"a.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)])
    values = ", ".join(f"round(CAST({c} AS DOUBLE), 9) + 0.0" for c in [*(f"a.{f}" for f in features), *(f"t.{s}" for s in stats)])
    out = [f"{name}a AS (SELECT *, row_number() OVER () AS id FROM ({both}))"]
    if keys:
        out.append(f"{name}t AS (SELECT m, {', '.join(keys)}, avg(y) AS level, stddev_pop(y) AS spread FROM {name}a WHERE train GROUP BY ALL)")
    return [*out, f"{name} AS (SELECT a.*, [{values}] AS v FROM {name}a a{f' JOIN {name}t t ON {on}' if keys else ''})"]
