"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string, bit by bit."""
    bits = (f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda k: "
            f"(ascii(substr({text}, i::BIGINT, 1))::UBIGINT >> k::UBIGINT) & 1::UBIGINT)))")
    step = "lambda c, b: xor(c >> 1::UBIGINT, (xor(c, b) & 1::UBIGINT) * 3988292384::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bits}), {step}), 4294967295::UBIGINT)"


def _framed(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _levels(name: str, group: str, base: str, depth: int) -> list[str]:
    """CTEs ``name0 ..``: the nodes ``(group, i, h, n)`` of each level from ``base`` up."""
    out = [f"{name}0 AS (SELECT {group} AS g, i, h, n FROM {base})"]
    for k in range(depth):
        out.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
                   f"(n + 15) // 16 AS n FROM {name}{k} GROUP BY g, i // 16, n)")
    return out


def _walk(name: str, start: str, levels: str, depth: int) -> list[str]:
    """CTEs that carry ``(id, g, i, cur, proof)`` up from ``start``, a level each."""
    out = [f"{name}0 AS (SELECT id, g, i, cur, proof FROM {start})"]
    for k in range(depth):
        out.append(
            f"{name}{k + 1} AS (SELECT p.id, p.g, p.i // 16 AS i, CASE WHEN any_value(t.n) = 1 THEN p.cur ELSE sha256("
            f"coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.i), '') || p.cur || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.i), '')) END AS cur, "
            f"p.proof || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> p.i), '') AS proof "
            f"FROM {name}{k} p JOIN {levels}{k} t ON p.g IS NOT DISTINCT FROM t.g AND p.i // 16 = t.i // 16 GROUP BY p.id, p.g, p.i, p.cur, p.proof)")
    return out


def merkle_sql(depth: int = 5, high: int = 3) -> str:
    """The manifest for sources of at most 16**depth rows and 16**high sources."""
    head = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc32_sql("coalesce(doc_id::VARCHAR, '')")
    ctes = [
        f"raw AS (SELECT doc_id, source, sha256({head} || {_framed('text')}) AS h, "
        f"CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {_framed(lowered)}) END AS low FROM documents)",
        "leaf AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, h) AS id, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM raw)",
        *_levels("t", "source", "leaf", depth),
        f"sub AS (SELECT 0 AS one, g AS source, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{depth})",
        *_levels("s", "one", "sub", high),
        "p AS (SELECT id, source AS g, i, coalesce(low, h) AS cur, '' AS proof FROM leaf)",
        *_walk("p", "p", "t", depth),
        f"q AS (SELECT p.id, 0 AS g, sub.i, p.cur, p.proof FROM p{depth} p JOIN sub ON p.g IS NOT DISTINCT FROM sub.source)",
        *_walk("q", "q", "s", high),
    ]
    return (f"WITH {', '.join(ctes)} SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, s.h AS root, sha256(q.proof) AS proof_sha256, "
            f"q.cur AS folded_root, q.cur = s.h AS verified FROM leaf JOIN q{high} q USING (id) JOIN sub ON leaf.source IS NOT DISTINCT FROM sub.source "
            f"CROSS JOIN s{high} s")


def repair_sql() -> str:
    """The damage, the faults and the cheapest repair: a recursion over the rows of all
    conversations, with the best edits of each state as plain strings.

    States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    kind = crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')") + " % 20"
    line = "CASE WHEN {out} IS NULL THEN {new} ELSE {out} || chr(10) || {new} END"
    added = line.format(out="a.out", new="s.lines")
    inserted = f"CASE WHEN s.k = 0 THEN a.out ELSE {added} END"
    kept = "x.role || ':' || x.text"
    given = "CASE WHEN s.mid = 2 THEN 'assistant:' ELSE 'user:' END || x.text"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {kind} AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE kind <> 0),
put AS (SELECT *, rtrim(text, {blanks}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
x AS (SELECT *, left(role, 1) AS init, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS nxt FROM put),
step(p, k, mid, lines) AS (VALUES (0, 0, 0, ''), (0, 1, 2, 'user:'), (0, 2, 3, 'user:' || chr(10) || 'assistant:'), (1, 0, 1, ''), (1, 1, 2, 'user:'),
    (1, 2, 3, 'user:' || chr(10) || 'assistant:'), (2, 0, 2, ''), (2, 1, 3, 'assistant:'), (3, 0, 3, ''), (3, 1, 2, 'user:')),
op(op, mid, init, dest, price) AS (VALUES ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0),
    ('R', 0, NULL, 2, 3), ('R', 1, NULL, 2, 3), ('R', 3, NULL, 2, 3), ('R', 2, NULL, 3, 3), ('D', 0, NULL, 0, 4), ('D', 1, NULL, 1, 4), ('D', 2, NULL, 2, 4), ('D', 3, NULL, 3, 4)),
best(conv_id, i, state, cost, audit, out) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR) FROM raw
  UNION ALL
  SELECT conv_id, i, dest, total, edits, lines FROM (SELECT a.conv_id, x.i, op.dest, a.cost + s.k * 3 + op.price + CASE WHEN x.fault = 3 AND op.op <> 'D' THEN 3 ELSE 0 END AS total, a.audit || repeat('I', s.k) || op.op AS edits,
    CASE op.op WHEN 'D' THEN {inserted} WHEN 'K' THEN {line.format(out=f'({inserted})', new=kept)} ELSE {line.format(out=f'({inserted})', new=given)} END AS lines
  FROM best a JOIN x ON x.conv_id IS NOT DISTINCT FROM a.conv_id AND x.i = a.i + 1 JOIN step s ON s.p = a.state JOIN op ON op.mid = s.mid
  WHERE (op.init IS NULL OR op.init = x.init) AND (x.fault IN (0, 3) OR op.op = 'D'))
  QUALIFY row_number() OVER (PARTITION BY conv_id, dest ORDER BY total, edits) = 1),
n AS (SELECT conv_id, max(i) AS n FROM best GROUP BY conv_id),
fin AS (SELECT conv_id, total AS cost, edits AS audit, lines AS out FROM (SELECT a.conv_id, a.cost + s.k * 3 AS total, a.audit || repeat('I', s.k) AS edits, {inserted} AS lines FROM best a JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id AND n.n = a.i
  JOIN step s ON s.p = a.state WHERE (a.state = 0 AND s.k = 0) OR (a.state > 0 AND s.mid = 3)) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total, edits) = 1),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
    count_if(fault = 3) AS truncated, count_if(nxt IS NOT NULL AND init || nxt NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT fin.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
  sha256(coalesce(out, '')) AS repaired_sha256
FROM fin LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM fin.conv_id"""
