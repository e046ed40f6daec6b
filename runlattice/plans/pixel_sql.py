"""DuckDB twins over pixels: each operator said again on the relation of foreground pixels, independent of runs."""

from __future__ import annotations

#: e: foreground pixels of emb8; n: its background; b: its ids; g: the grid.
EMB8 = """
g AS (SELECT x, y FROM (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 8)) AS y)),
b AS (SELECT vec_id AS id, label FROM embeddings),
e AS (SELECT vec_id AS id, x, y FROM embeddings, g WHERE embedding[x * 8 + y + 1] > 0),
n AS (SELECT id, x, y FROM b, g EXCEPT SELECT id, x, y FROM e)
"""
#: Pairs of a mask and that of the next id; i: their bits.
PAIR = """,
b2 AS (SELECT id FROM b WHERE id + 1 IN (SELECT id FROM b)),
e2 AS (SELECT id - 1 AS id, x, y FROM e),
i AS (SELECT b2.id, g.x, g.y, (e.id IS NOT NULL)::INT AS a, (e2.id IS NOT NULL)::INT AS c FROM b2 CROSS JOIN g LEFT JOIN e ON e.id = b2.id AND e.x = g.x AND e.y = g.y LEFT JOIN e2 ON e2.id = b2.id AND e2.x = g.x AND e2.y = g.y)
"""
ACT = """
e AS (SELECT DISTINCT user_id AS id, dayofweek(ts) AS x, hour(ts) AS y FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT DISTINCT id FROM e)
"""


def box(orders: int = 10) -> str:
    return f"""
b AS (SELECT l_orderkey // {orders} AS image, (((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 51 + l_quantity::BIGINT AS id, l_linenumber AS depth, l_partkey % 40 AS x0, l_suppkey % 30 AS y0, 1 + l_linenumber AS bw, 1 + l_quantity::BIGINT % 12 AS bh FROM lineitem),
e AS (SELECT image, id, depth, x, y FROM (SELECT *, unnest(range(x0, least(x0 + bw, 64))) AS x FROM b) AS c, LATERAL (SELECT unnest(range(c.y0, least(c.y0 + c.bh, 48))) AS y))
"""


def counts(pixels: str, extent: str = "SELECT id, 8 AS h, 8 AS w FROM b", base: str = EMB8, keys: str = "id") -> str:
    """Runs of the masks with these pixels (keys, x, y) and extents (keys, h, w) as strings."""
    return f"""
WITH {base},
p AS ({pixels}),
o AS ({extent}),
q AS (SELECT DISTINCT {keys}, x * h + y AS pos FROM p JOIN o USING ({keys})),
s AS (SELECT {keys}, min(pos) AS s, max(pos) + 1 AS t FROM (SELECT *, pos - row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS k FROM q) GROUP BY {keys}, k),
r AS (SELECT {keys}, list_sort(flatten(list([s, t]))) AS ends FROM s GROUP BY {keys}),
z AS (SELECT {keys}, h * w AS size, list_filter(coalesce(ends, []::BIGINT[]), lambda v: v < h * w) AS ends FROM o LEFT JOIN r USING ({keys})),
y AS (SELECT {keys}, size, ends || [size] AS t, [0] || ends AS f FROM z)
SELECT {keys}, CASE WHEN size = 0 THEN '' ELSE array_to_string(list_transform(range(1, len(t) + 1), lambda j: t[j] - f[j]), ',') END AS counts FROM y
"""


def pair(table: int) -> str:
    return counts(f"SELECT id, x, y FROM i WHERE ({table} >> (2 * a + c)) & 1 = 1", "SELECT id, 8 AS h, 8 AS w FROM b2", EMB8 + PAIR)


def groups(condition: str) -> str:
    """Masks of each label: n masks, of which k are set at a pixel; s is the sum of id % 3 + 1 of these."""
    return counts(
        f"SELECT label AS id, x, y FROM (SELECT l.label, g.x, g.y, l.n, coalesce(c.k, 0) AS k, coalesce(c.s, 0) AS s FROM (SELECT label, count(*) AS n FROM b GROUP BY label) AS l CROSS JOIN g LEFT JOIN (SELECT label, x, y, count(*) AS k, sum(id % 3 + 1) AS s FROM e JOIN b USING (id) GROUP BY label, x, y) AS c ON c.label = l.label AND c.x = g.x AND c.y = g.y) WHERE {condition}",
        "SELECT DISTINCT label AS id, 8 AS h, 8 AS w FROM b",
    )


def dilated(source: str, offsets: list[tuple[int, int]]) -> str:
    """Pixels of source moved by each offset (dx, dy), within the grid."""
    values = ", ".join(f"({dx}, {dy})" for dx, dy in offsets)
    return f"SELECT DISTINCT id, x + dx AS x, y + dy AS y FROM {source}, (VALUES {values}) AS k(dx, dy) WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7"


def eroded(source_background: str, offsets: list[tuple[int, int]]) -> str:
    return f"SELECT id, x, y FROM b, g EXCEPT ({dilated(source_background, offsets)})"


def remapped(rows: tuple[float, float, int], cols: tuple[float, float, int]) -> str:
    """Destination pixels whose source, ceil((d + 0.5 - b) / a) - 1 along each axis, is set."""
    (ay, by, h), (ax, bx, w) = rows, cols
    return f"SELECT id, dx AS x, dy AS y FROM e JOIN (SELECT unnest(range(0, {w})) AS dx) ON e.x = ceil((dx + 0.5 - {bx}) / {ax}) - 1 JOIN (SELECT unnest(range(0, {h})) AS dy) ON e.y = ceil((dy + 0.5 - {by}) / {ay}) - 1"


def blocks(least: int, kh: int = 2, kw: int = 2, sy: int = 2, sx: int = 2) -> str:
    """Windows with at least so many pixels."""
    oh, ow = (8 - kh) // sy + 1, (8 - kw) // sx + 1
    return f"SELECT id, ox AS x, oy AS y FROM e JOIN (SELECT unnest(range(0, {ow})) AS ox) ON x BETWEEN ox * {sx} AND ox * {sx} + {kw - 1} JOIN (SELECT unnest(range(0, {oh})) AS oy) ON y BETWEEN oy * {sy} AND oy * {sy} + {kh - 1} GROUP BY id, ox, oy HAVING count(*) >= {least}"


def reach(source: str, connectivity: int) -> str:
    """c: pixels of source with the least pixel (x * 8 + y) that they are connected to."""
    near = "abs(t.x - f.x) + abs(t.y - f.y) = 1" if connectivity == 4 else "abs(t.x - f.x) <= 1 AND abs(t.y - f.y) <= 1"
    return f""",
l(id, x, y, root) AS (SELECT id, x, y, x * 8 + y FROM {source} UNION SELECT t.id, t.x, t.y, f.root FROM l AS f JOIN {source} AS t ON t.id = f.id AND {near}),
c AS (SELECT id, x, y, min(root) AS root FROM l GROUP BY id, x, y),
a AS (SELECT id, root, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS cx, avg(y) AS cy FROM c GROUP BY id, root)
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
