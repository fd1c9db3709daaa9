"""DuckDB SQL that answers each named query from the raw tables, independently."""

from __future__ import annotations

_SPREAD = "(event_id*event_id*31 + event_id*7919 + user_id*104729) % 1000003"

PLACEMENTS = f"""
spread AS (SELECT *, {_SPREAD} AS h FROM events),
placements AS (
  SELECT event_id // 1000 AS board_id, event_id AS id, (h % 38) - 19 AS x,
         ((h // 38) % 38) - 19 AS y, user_id % 4 AS uid
  FROM spread)"""


def _labelled(source: str, name: str, where: str = "true") -> str:
    """CTEs that label the 4-connected blocks of ``source`` as ``name``."""
    return f"""
{name}_edge AS MATERIALIZED (
  SELECT a.board_id, a.id AS a, b.id AS b
  FROM {source} a CROSS JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) AS d(dx, dy)
  JOIN {source} b ON b.board_id = a.board_id AND b.uid = a.uid
                 AND b.x = a.x + d.dx AND b.y = a.y + d.dy),
{name}_reach AS (
  SELECT board_id, id, id AS root FROM {source}
  UNION
  SELECT r.board_id, e.b, r.root
  FROM {name}_reach r JOIN {name}_edge e ON e.board_id = r.board_id AND e.a = r.id),
{name} AS MATERIALIZED (
  SELECT s.board_id, s.id, s.x, s.y, r.bid, s.uid
  FROM {source} s
  JOIN (SELECT board_id, id, min(root) AS bid FROM {name}_reach GROUP BY ALL) r
    USING (board_id, id))"""


STONES = (
    "WITH RECURSIVE"
    + PLACEMENTS
    + """,
loaded AS MATERIALIZED (
  SELECT * FROM placements
  QUALIFY row_number() OVER (PARTITION BY board_id, x, y ORDER BY id) = 1),"""
    + _labelled("loaded", "stones")
)

SMALL = (
    f"""WITH RECURSIVE
spread AS (SELECT *, {_SPREAD} AS h FROM events),
tries AS (
  SELECT event_id // 40 AS board_id, event_id AS id, h % 6 AS x, (h // 6) % 6 AS y,
         user_id % 4 AS uid
  FROM spread),
arrived AS MATERIALIZED (
  SELECT * FROM tries
  QUALIFY row_number() OVER (PARTITION BY board_id, x, y ORDER BY id) = 1),
newest AS (
  SELECT * FROM arrived QUALIFY row_number() OVER (PARTITION BY board_id ORDER BY id DESC) = 1),
earlier AS (SELECT * FROM arrived WHERE (board_id, id) NOT IN (SELECT (board_id, id) FROM newest)),"""
    + _labelled("earlier", "before_last")
    + """,
small AS MATERIALIZED (
  SELECT board_id, id, x, y, bid, uid FROM before_last
  UNION ALL
  SELECT board_id, id, x, y, id, uid FROM newest)"""
)

_SIDES = "(VALUES (1,0),(-1,0),(0,1),(0,-1))"


def _free(table: str, name: str = "free") -> str:
    """CTE of each block's distinct empty neighbour cells."""
    return f"""
{name} AS MATERIALIZED (
  SELECT DISTINCT s.board_id, s.bid, s.uid, s.x + d.dx AS x, s.y + d.dy AS y
  FROM {table} s CROSS JOIN {_SIDES} AS d(dx, dy)
  WHERE NOT EXISTS (SELECT 1 FROM {table} o
                    WHERE o.board_id = s.board_id AND o.x = s.x + d.dx AND o.y = s.y + d.dy))"""


_SIZES = """
sizes AS MATERIALIZED (
  SELECT b.board_id, b.bid, b.uid, b.stones, coalesce(f.n, 0)::BIGINT AS liberties
  FROM (SELECT board_id, bid, min(uid) AS uid, count(*) AS stones FROM stones GROUP BY ALL) b
  LEFT JOIN (SELECT board_id, bid, count(*) AS n FROM free GROUP BY ALL) f USING (board_id, bid))"""

SIZED = STONES + "," + _free("stones") + "," + _SIZES

_COLUMNS = "board_id, id, x, y, bid, uid"


def _related(table: str) -> str:
    """CTEs of the last stones and their related blocks."""
    return f"""
top AS MATERIALIZED (
  SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY board_id ORDER BY id DESC) = 1),
adjoining AS MATERIALIZED (
  SELECT s.* FROM {table} s JOIN top t ON s.board_id = t.board_id
    AND abs(s.x - t.x) + abs(s.y - t.y) <= 1),
related AS MATERIALIZED (
  SELECT DISTINCT a.board_id, a.bid, a.uid, CASE WHEN a.uid = t.uid THEN 'own' ELSE 'enemy' END AS side
  FROM adjoining a JOIN top t USING (board_id))"""


LAST = SMALL + "," + _related("small")

MERGED = (
    LAST
    + """,
merged AS MATERIALIZED (
  SELECT s.board_id, s.id, s.x, s.y, s.uid,
         CASE WHEN (s.board_id, s.bid) IN (SELECT (board_id, bid) FROM related WHERE side = 'own')
              THEN (SELECT min(r.bid) FROM related r WHERE r.board_id = s.board_id AND r.side = 'own')
              ELSE s.bid END AS bid
  FROM small s),"""
    + _free("merged")
    + """,
related2 AS MATERIALIZED (
  SELECT DISTINCT m.board_id, m.bid, m.uid, CASE WHEN m.uid = t.uid THEN 'own' ELSE 'enemy' END AS side
  FROM merged m JOIN top t ON m.board_id = t.board_id AND abs(m.x - t.x) + abs(m.y - t.y) <= 1),
doomed AS MATERIALIZED (
  SELECT r.* FROM related2 r
  WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.board_id = r.board_id AND f.bid = r.bid)),
kept AS MATERIALIZED (
  SELECT * FROM merged m WHERE NOT EXISTS (
    SELECT 1 FROM doomed d WHERE d.board_id = m.board_id AND d.bid = m.bid AND d.side = 'enemy')),"""
    + _free("kept", "free2")
)

RECTS = """
boxes AS (
  SELECT o_orderkey AS request_id,
         o_orderkey % (SELECT max(event_id) // 1000 + 1 FROM events) AS board_id,
         o_orderkey % 30 - 19 AS x1, o_orderkey % 30 - 17 + o_custkey % 8 AS x2,
         (o_orderkey // 30) % 30 - 19 AS y1,
         (o_orderkey // 30) % 30 - 17 + (o_custkey // 8) % 8 AS y2
  FROM orders),
rects AS (
  SELECT request_id, board_id, x1, y1, x2, y2 FROM boxes
  WHERE request_id % 7 <> 0 OR (request_id // 7) % 8 = 6)"""

LARGE = """
large AS (
  SELECT c_custkey AS request_id,
         c_custkey % (SELECT max(event_id) // 1000 + 1 FROM events) AS board_id,
         CASE c_custkey % 4 WHEN 0 THEN -600 - c_custkey % 9 WHEN 1 THEN c_custkey % 38 - 19
              WHEN 2 THEN -400 - c_custkey % 50 ELSE -20000 END AS x1,
         CASE c_custkey % 4 WHEN 0 THEN c_custkey % 38 - 19 WHEN 1 THEN -600 - c_custkey % 9
              WHEN 2 THEN -30 - c_custkey % 9 ELSE c_custkey % 38 - 59 END AS y1,
         CASE c_custkey % 4 WHEN 0 THEN 600 + c_custkey % 7 WHEN 1 THEN c_custkey % 38 - 18
              WHEN 2 THEN 400 + c_custkey % 30 ELSE 20000 END AS x2,
         CASE c_custkey % 4 WHEN 0 THEN c_custkey % 38 - 18 WHEN 1 THEN 600 + c_custkey % 7
              WHEN 2 THEN 300 + c_custkey % 20 ELSE c_custkey % 38 + 21 END AS y2
  FROM customer),
bands AS (
  SELECT *, 65536 // (least(x2, 10000) - greatest(x1, -10000) + 1) AS band FROM large),
parts AS (
  SELECT *, ((y2 - y1 + band) // band)::BIGINT AS parts,
         unnest(range(0, (y2 - y1 + band) // band))::BIGINT AS part
  FROM bands)"""

_RECT_MSG = """CASE WHEN request_id % 7 <> 0 THEN 'OK' ELSE CASE (request_id // 7) % 8
  WHEN 0 THEN 'no x1' WHEN 1 THEN 'x1 not int' WHEN 2 THEN 'x1<x2' WHEN 3 THEN 'no y2'
  WHEN 4 THEN 'y2 should be int' WHEN 5 THEN 'y1<y2' WHEN 6 THEN 'OK'
  ELSE 'y2 should be int' END END"""

def _spelled(field: str) -> list[str]:
    """The field in every mixture of cases; test bodies have a value under one at most."""
    ways = [""]
    for c in field:
        ways = [w + d for w in ways for d in (c, c.upper())]
    return ways


def _json_type(field: str) -> str:
    each = [f"nullif(json_type(j, '$.{n}'), 'NULL')" for n in _spelled(field)]
    return f"coalesce({', '.join(each)}, 'NULL')"


def _json_value(field: str) -> str:
    return f"coalesce({', '.join(f"json_extract_string(j, '$.{n}')" for n in _spelled(field))})"


MOVES_JSON = (
    "WITH"
    + PLACEMENTS
    + """,
bodies AS (
  SELECT board_id, id, CASE WHEN id % 11 <> 0
      THEN '{"x":' || x || ',"y":' || y || ',"uid":' || uid || '}'
    ELSE CASE (id // 11) % 14
    WHEN 0 THEN '{"x":"' || x || '","y":' || y || ',"uid":' || uid || '}'
    WHEN 1 THEN '{"x":' || x || '.5,"y":' || y || ',"uid":' || uid || '}'
    WHEN 2 THEN '{"x":' || x || ',"uid":' || uid || '}'
    WHEN 3 THEN 'oops ' || x
    WHEN 4 THEN 'null'
    WHEN 5 THEN '[' || x || ',' || y || ']'
    WHEN 6 THEN '{"X":' || x || ',"Y":' || y || ',"Uid":' || uid || '}'
    WHEN 7 THEN '{"x":null,"y":' || y || ',"uid":' || uid || ',"z":"q"}'
    WHEN 8 THEN '{"x":' || x || ',"y":99999999999999999999,"uid":' || uid || '}'
    WHEN 9 THEN '{"x":1e2,"y":' || y || ',"uid":' || uid || '}'
    WHEN 10 THEN '{"x":' || x || ',"y":' || y || ',"uid":true}'
    WHEN 11 THEN '{"x":' || x || ',"y":' || y || ',"uId":' || uid || '}'
    WHEN 12 THEN '{"X":' || x || ',"x":null,"y":' || y || ',"UID":null,"uiD":' || uid || '}'
    ELSE '' END END AS body
  FROM placements),
fields AS (
  SELECT board_id, id, CASE WHEN json_valid(body) THEN body END AS j FROM bodies),
typed AS (
  SELECT board_id, id, j, json_type(j) AS top,
""" + ",\n".join(f"    {_json_type(f)} AS t{f[0]}" for f in ("x", "y", "uid")) + """,
""" + ",\n".join(f"    {_json_value(f)} AS v{f[0]}" for f in ("x", "y", "uid")) + """
  FROM fields),
parsed AS (
  SELECT *, coalesce(top IN ('OBJECT', 'NULL')
    AND tx IN ('BIGINT', 'UBIGINT', 'NULL') AND ty IN ('BIGINT', 'UBIGINT', 'NULL')
    AND tu IN ('BIGINT', 'UBIGINT', 'NULL'), false) AS ok
  FROM typed),
moves AS (
  SELECT board_id, id, CASE WHEN ok THEN 0 ELSE -1 END::BIGINT AS code,
    CASE WHEN ok THEN coalesce(try_cast(vx AS BIGINT), 0) END AS x,
    CASE WHEN ok THEN coalesce(try_cast(vy AS BIGINT), 0) END AS y,
    CASE WHEN ok THEN coalesce(try_cast(vu AS BIGINT), 0) END AS uid
  FROM parsed)"""
)

# One row per board and step: the state as a list of stones keyed by a cell number.
_NEAR = "s.k IN (k + 1, k - 1, k + 100, k - 100)"
_OPEN = (
    "list_distinct(list_transform(list_filter({s}, lambda s: NOT ("
    "list_contains({ks}, s.k + 1) AND list_contains({ks}, s.k - 1) AND "
    "list_contains({ks}, s.k + 100) AND list_contains({ks}, s.k - 100))), lambda s: s.bid))"
)
_STATE = "STRUCT(id BIGINT, k BIGINT, uid BIGINT, bid BIGINT)[]"
_PLAYED = f"""
  UNION ALL
  SELECT board_id, n, id,
    CASE WHEN occ THEN 'occupied' WHEN suicide THEN 'suicide' ELSE 'placed' END,
    CASE WHEN occ THEN 0 ELSE len(s1) - len(s2) END::BIGINT,
    CASE WHEN occ THEN 0 ELSE (len(own) > 0)::INT END::BIGINT,
    CASE WHEN occ THEN st WHEN suicide THEN list_filter(s2, lambda s: s.bid <> low) ELSE s2 END
  FROM (
    SELECT *, NOT list_contains({_OPEN.format(s="s2", ks="ks2")}, low) AS suicide
    FROM (
      SELECT *, list_transform(s2, lambda s: s.k) AS ks2
      FROM (
        SELECT *, list_filter(s1, lambda s: NOT list_contains(gone, s.bid)) AS s2
        FROM (
          SELECT *, list_filter(enemy, lambda e: NOT list_contains(alive, e)) AS gone
          FROM (
            SELECT *, {_OPEN.format(s="s1", ks="ks")} AS alive,
              list_distinct(list_transform(list_filter(s1, lambda s: s.uid <> uid AND {_NEAR}),
                lambda s: s.bid)) AS enemy
            FROM (
              SELECT *, list_transform(s1, lambda s: s.k) AS ks
              FROM (
                SELECT *, list_append(list_transform(st, lambda s: {{'id': s.id, 'k': s.k, 'uid': s.uid,
                    'bid': CASE WHEN list_contains(own, s.bid) THEN low ELSE s.bid END}}),
                    {{'id': id, 'k': k, 'uid': uid, 'bid': low}}) AS s1
                FROM (
                  SELECT *, list_min(list_append(own, id)) AS low
                  FROM (
                    SELECT m.board_id, m.n, m.id, m.k, m.uid, p.st,
                      list_contains(list_transform(p.st, lambda s: s.k), m.k) AS occ,
                      list_distinct(list_transform(list_filter(p.st, lambda s: s.uid = m.uid
                        AND s.k IN (m.k + 1, m.k - 1, m.k + 100, m.k - 100)), lambda s: s.bid)) AS own
                    FROM played p JOIN moves m ON m.board_id = p.board_id AND m.n = p.n + 1
                  ))))))))))"""

_FIRST = "0::BIGINT AS n, 0::BIGINT AS id, '' AS outcome, 0::BIGINT AS captured, 0::BIGINT AS merged"

REPLAY = (
    f"""WITH RECURSIVE
spread AS (SELECT *, {_SPREAD} AS h FROM events),
moves AS MATERIALIZED (
  SELECT user_id AS board_id, event_id AS id, h % 6 AS x, (h // 6) % 6 AS y, event_id % 2 AS uid,
         (h % 6 + 1) * 100 + (h // 6) % 6 + 1 AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM spread),
played AS (
  SELECT DISTINCT board_id, {_FIRST}, []::{_STATE} AS st FROM moves"""
    + _PLAYED
)

REPLAY_ON_STONES = (
    STONES
    + f""",
tries AS (
  SELECT c_custkey % (SELECT max(event_id) // 1000 + 1 FROM events) AS board_id,
         1000000000 + c_custkey AS id,
         (c_custkey * c_custkey * 17 + c_custkey * 7919) % 1000003 AS h
  FROM customer),
moves AS MATERIALIZED (
  SELECT board_id, id, h % 38 - 19 AS x, (h // 38) % 38 - 19 AS y, (h // 1444) % 4 AS uid,
         (h % 38 + 1) * 100 + (h // 38) % 38 + 1 AS k,
         row_number() OVER (PARTITION BY board_id ORDER BY id) AS n
  FROM tries),
played AS (
  SELECT board_id, {_FIRST},
         list({{'id': id, 'k': (x + 20) * 100 + y + 20, 'uid': uid, 'bid': bid}})::{_STATE} AS st
  FROM stones GROUP BY board_id"""
    + _PLAYED
)

_REPLAY_LOG = REPLAY + """
SELECT m.board_id, m.id, m.x, m.y, m.uid, p.outcome, p.captured, p.merged
FROM played p JOIN moves m ON m.board_id = p.board_id AND m.n = p.n"""

_MOVED = f"""WITH spread AS (SELECT *, {_SPREAD} AS h FROM events),
moves AS (
  SELECT user_id AS board_id, event_id AS id, h % 6 AS x, (h // 6) % 6 AS y, event_id % 2 AS uid, ts,
         floor(epoch(ts))::BIGINT AS s
  FROM spread),
ahead AS (
  SELECT *, lead(s) OVER w AS next_s, lead(id) OVER w AS next_id, lag(s) OVER w AS prev_s
  FROM moves WINDOW w AS (PARTITION BY board_id ORDER BY s, id))"""

_ENV = _MOVED + """,
ends AS (
  SELECT board_id, min(ts) AS t0, max(ts) AS t1, max_by(x, id) AS x, max_by(y, id) AS y,
         max_by(uid, id) AS uid
  FROM moves GROUP BY board_id)"""


def _bits(row: int, bits: int) -> str:
    return (
        f"coalesce(sum(CASE WHEN y = {row} AND x BETWEEN {19 - bits} AND 18 "
        f"THEN 1 << (18 - x) END), 0)::BIGINT"
    )


_CODED = (
    STONES
    + f""",
spelled AS (
  SELECT board_id, {_bits(0, 14)} AS cx, {_bits(2, 14)} AS cy, {_bits(4, 14)} AS x1,
         {_bits(6, 14)} AS x2, {_bits(5, 14)} AS y1, {_bits(7, 14)} AS y2
  FROM stones GROUP BY board_id),
far AS (
  SELECT board_id, 1000000000000 + board_id * 10 + k AS id,
         [cx, cx + 1, x1, x2, x2 + 1][k + 1] AS x, [cy, cy, y1, y2, y2][k + 1] AS y, 1 AS uid
  FROM spelled, range(5) AS r(k)),
every_stone AS MATERIALIZED (
  SELECT board_id, id, x, y, uid FROM stones
  UNION ALL SELECT board_id, id, x, y, uid FROM far WHERE x <= 10000 AND y <= 10000),
unique_cells AS MATERIALIZED (
  SELECT * FROM every_stone QUALIFY row_number() OVER (PARTITION BY board_id, x, y ORDER BY id) = 1),"""
    + _labelled("unique_cells", "coded")
    + f""",
code AS (
  SELECT board_id, {_bits(0, 14)} AS cx, {_bits(2, 14)} AS cy, {_bits(4, 14)} AS x1,
         {_bits(6, 14)} AS x2, {_bits(5, 14)} AS y1, {_bits(7, 14)} AS y2
  FROM coded GROUP BY board_id),
hit AS (SELECT s.board_id, s.bid FROM coded s JOIN code c ON s.board_id = c.board_id
        AND s.x = c.cx AND s.y = c.cy)"""
)
_IN_CODE = "s.x BETWEEN c.x1 AND c.x2 AND s.y BETWEEN c.y1 AND c.y2"
_IN_SQUARE = "x BETWEEN 0 AND 18 AND y BETWEEN 0 AND 18"

_CANDIDATES = (
    SIZED
    + f""",
cells AS MATERIALIZED (
  SELECT DISTINCT s.board_id, s.x + d.dx AS x, s.y + d.dy AS y
  FROM stones s CROSS JOIN {_SIDES} AS d(dx, dy)),
near AS MATERIALIZED (
  SELECT c.board_id, c.x, c.y, s.bid, count(*) AS sides
  FROM cells c CROSS JOIN {_SIDES} AS d(dx, dy)
  JOIN stones s ON s.board_id = c.board_id AND s.x = c.x + d.dx AND s.y = c.y + d.dy
  GROUP BY ALL),
moves AS (SELECT c.*, u.uid FROM cells c CROSS JOIN (SELECT unnest(range(4)) AS uid) u)"""
)

_OUTCOMES = (
    _CANDIDATES
    + """,
judged AS (
  SELECT m.board_id, m.x, m.y, m.uid,
    sum(n.sides) AS sides,
    count(*) FILTER (z.uid <> m.uid AND z.liberties = 1) AS captured_blocks,
    coalesce(sum(z.stones) FILTER (z.uid <> m.uid AND z.liberties = 1), 0) AS captured_stones,
    coalesce(sum(z.stones) FILTER (z.uid = m.uid), 0) AS own_stones,
    coalesce(bool_and(z.liberties = 1) FILTER (z.uid = m.uid), true) AS own_last,
    min(n.bid) FILTER (z.uid = m.uid) AS merged_bid
  FROM moves m JOIN near n USING (board_id, x, y)
  JOIN sizes z ON z.board_id = n.board_id AND z.bid = n.bid
  GROUP BY ALL),
flags AS (
  SELECT j.*, NOT EXISTS (SELECT 1 FROM stones s WHERE s.board_id = j.board_id AND s.x = j.x AND s.y = j.y) AS ok
  FROM judged j),
marked AS (
  SELECT *, ok AND captured_blocks = 0 AND sides = 4 AND own_last AS suicidal FROM flags)
SELECT board_id, x, y, uid, ok::BIGINT AS accepted,
  CASE WHEN ok THEN captured_blocks ELSE 0 END::BIGINT AS captured_blocks,
  CASE WHEN ok THEN captured_stones ELSE 0 END::BIGINT AS captured_stones,
  suicidal::BIGINT AS suicide,
  CASE WHEN suicidal THEN own_stones + 1 ELSE 0 END::BIGINT AS lost_stones,
  CASE WHEN ok THEN merged_bid END AS merged_bid
FROM marked"""
)

ORACLES: dict[str, str] = {
    "stones_scan": f"{STONES} SELECT {_COLUMNS} FROM stones",
    "moves_parsed": f"{MOVES_JSON} SELECT * FROM moves",
    "move_status_json": f"""{MOVES_JSON} SELECT board_id, id,
      CASE WHEN code = 0 THEN '{{"code":0,"msg":"OK","data":[]}}'
           ELSE '{{"code":-1,"msg":"not a move","data":[]}}' END AS body FROM moves""",
    "rect_requests_checked": f"""WITH {RECTS},
    checked AS (SELECT *, {_RECT_MSG} AS msg FROM boxes)
    SELECT request_id, board_id, CASE WHEN msg = 'OK' THEN 0 ELSE -1 END::BIGINT AS code, msg,
      CASE WHEN msg = 'OK' THEN x1 END AS x1, CASE WHEN msg = 'OK' THEN y1 END AS y1,
      CASE WHEN msg = 'OK' THEN x2 END AS x2, CASE WHEN msg = 'OK' THEN y2 END AS y2
    FROM checked""",
    "stones_checked": f"""WITH {PLACEMENTS},
    damaged AS (
      SELECT board_id, id, CASE WHEN id % 97 = 0 THEN x + 10019 ELSE x END AS x,
        CASE WHEN id % 101 = 0 THEN y - 10019 ELSE y END AS y,
        CASE WHEN id % 89 <> 0 THEN uid END AS uid
      FROM placements),
    ruled AS (
      SELECT *, CASE WHEN abs(x) > 10000 OR abs(y) > 10000 THEN 'out_of_range'
                     WHEN uid IS NULL THEN 'null_owner' END AS rule FROM damaged)
    SELECT board_id, id, x, y, uid, CASE WHEN rule IS NOT NULL THEN rule
      WHEN row_number() OVER (PARTITION BY board_id, x, y, rule ORDER BY id) > 1 THEN 'occupied' END AS reason
    FROM ruled""",
    "assigned_ids": """SELECT user_id AS board_id, event_id,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM events""",
    "assigned_labels": f"""{STONES}
    SELECT p.board_id, p.id, (SELECT max(s.bid) FROM stones s WHERE s.board_id = p.board_id)
      + row_number() OVER (PARTITION BY p.board_id ORDER BY p.id) AS bid FROM placements p""",
    "next_bid": f"{STONES} SELECT board_id, coalesce(max(bid), 0) + 1 AS next_bid FROM stones GROUP BY board_id",
    "border_cells": f"""{STONES},
    line AS (SELECT unnest(generate_series(-1, 19)) AS v),
    ring AS (SELECT a.v AS x, b.v AS y FROM line a CROSS JOIN line b
             WHERE a.v IN (-1, 19) OR b.v IN (-1, 19)),
    tops AS (SELECT board_id, max(bid) + 1 AS bid FROM stones GROUP BY board_id)
    SELECT t.board_id, r.x, r.y, t.bid, 4294967040::BIGINT AS uid,
      EXISTS (SELECT 1 FROM stones s WHERE s.board_id = t.board_id AND s.x = r.x AND s.y = r.y)::BIGINT AS taken
    FROM tops t CROSS JOIN ring r""",
    "std_area": f"""{STONES},
    line AS (SELECT unnest(generate_series(0, 18)) AS v),
    area AS (SELECT b.board_id, i.v AS x, j.v AS y
             FROM (SELECT DISTINCT board_id FROM stones) b CROSS JOIN line i CROSS JOIN line j)
    SELECT a.board_id, a.x, a.y, s.uid FROM area a LEFT JOIN stones s
      ON s.board_id = a.board_id AND s.x = a.x AND s.y = a.y""",
    "rect_json": f"""{STONES}, {RECTS}
    SELECT r.request_id, 0::BIGINT AS part, 1::BIGINT AS parts,
      coalesce((to_json(list({{'x': s.x, 'y': s.y, 'uid': s.uid}} ORDER BY s.y, s.x)
        FILTER (s.id IS NOT NULL)))::VARCHAR, '[]') AS body
    FROM rects r LEFT JOIN stones s ON s.board_id = r.board_id
      AND s.x BETWEEN r.x1 AND r.x2 AND s.y BETWEEN r.y1 AND r.y2
    GROUP BY r.request_id""",
    "snapshot_roundtrip": f"{SMALL} SELECT {_COLUMNS} FROM small",
    "neighbour_cells": f"""{STONES} SELECT DISTINCT s.board_id, s.x + d.dx AS x, s.y + d.dy AS y
    FROM stones s CROSS JOIN {_SIDES} AS d(dx, dy)""",
    "rect_stones": f"{STONES} SELECT {_COLUMNS} FROM stones WHERE x BETWEEN -5 AND 7 AND y BETWEEN -6 AND 9",
    "viewport_rects": """WITH v AS (
      SELECT c_custkey AS view_id, c_custkey % 1000 + 320 AS w, c_custkey % 700 + 200 AS h,
        c_custkey % 640 - 77 AS b_x, c_custkey % 480 + 13 AS b_y,
        CASE c_custkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS s
      FROM customer),
    b AS (SELECT view_id, w / 2.0::DOUBLE - b_x AS cx, h / 2.0::DOUBLE - b_y AS cy,
                 w / s / 2.0::DOUBLE AS hx, h / s / 2.0::DOUBLE AS hy FROM v)
    SELECT view_id, trunc((cx - hx) / 25.0::DOUBLE)::BIGINT - 1 AS x1,
      trunc((cy - hy) / 25.0::DOUBLE)::BIGINT - 1 AS y1,
      trunc((cx + hx) / 25.0::DOUBLE)::BIGINT + 1 AS x2,
      trunc((cy + hy) / 25.0::DOUBLE)::BIGINT + 1 AS y2 FROM b""",
    "snapped_points": """WITH v AS (
      SELECT c_custkey AS view_id, (c_custkey * 37) % 1320 AS px, (c_custkey * 53) % 900 AS py,
        c_custkey % 640 - 77 AS b_x, c_custkey % 480 + 13 AS b_y,
        CASE c_custkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS s
      FROM customer)
    SELECT view_id, floor((px - b_x) / s / 25.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS x,
      floor((py - b_y) / s / 25.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS y FROM v""",
    "decoded_rows": f"{STONES} SELECT board_id, "
    + ", ".join(f"{_bits(r, 14)} AS row{r}" for r in (0, 2, 4, 5, 6, 7))
    + " FROM stones GROUP BY board_id",
    "last_stone": f"{LAST} SELECT {_COLUMNS} FROM top",
    "adjoining_stones": f"{LAST} SELECT {_COLUMNS} FROM adjoining",
    "last_open_sides": f"""{LAST} SELECT t.board_id, (4 - (SELECT count(*) FROM small s
      WHERE s.board_id = t.board_id AND abs(s.x - t.x) + abs(s.y - t.y) = 1))::BIGINT AS open_sides FROM top t""",
    "related_blocks": f"{LAST} SELECT board_id, bid, uid, side FROM related",
    "related_except_own": f"""{LAST} SELECT board_id, bid FROM related
      EXCEPT SELECT board_id, bid FROM related WHERE side = 'own'""",
    "block_table": f"{SIZED} SELECT board_id, bid, uid, liberties AS qi FROM sizes",
    "stones_with_block": f"{STONES} SELECT board_id, x, y, bid, uid FROM stones",
    "orphan_cells": f"""{SIZED} SELECT s.board_id, s.x, s.y, s.bid FROM stones s
      JOIN sizes z USING (board_id, bid) WHERE z.liberties = 0""",
    "rect_join_counts": f"""{STONES}, {RECTS}
    SELECT r.request_id, r.board_id, count(s.id) AS stones FROM rects r LEFT JOIN stones s
      ON s.board_id = r.board_id AND s.x BETWEEN r.x1 AND r.x2 AND s.y BETWEEN r.y1 AND r.y2
    GROUP BY ALL""",
    "rect_counts_large": f"""{STONES}, {LARGE}
    SELECT r.request_id, r.board_id, count(s.id) AS stones FROM large r LEFT JOIN stones s
      ON s.board_id = r.board_id AND s.x BETWEEN r.x1 AND r.x2 AND s.y BETWEEN r.y1 AND r.y2
    GROUP BY ALL""",
    "rect_json_large": f"""{STONES}, {LARGE}
    SELECT r.request_id, r.part, r.parts,
      coalesce((to_json(list({{'x': s.x, 'y': s.y, 'uid': s.uid}} ORDER BY s.y, s.x)
        FILTER (s.id IS NOT NULL)))::VARCHAR, '[]') AS body
    FROM parts r LEFT JOIN stones s ON s.board_id = r.board_id AND s.x BETWEEN r.x1 AND r.x2
      AND s.y BETWEEN r.y1 + r.part * r.band AND least(r.y2, r.y1 + (r.part + 1) * r.band - 1)
    GROUP BY ALL""",
    "rect_join_stones": f"""{STONES}, {RECTS}
    SELECT r.request_id, s.id, s.x, s.y, s.bid, s.uid, r.board_id FROM rects r JOIN stones s
      ON s.board_id = r.board_id AND s.x BETWEEN r.x1 AND r.x2 AND s.y BETWEEN r.y1 AND r.y2""",
    "block_neighbours": f"""{STONES} SELECT DISTINCT s.board_id, s.bid, s.uid, s.x + d.dx AS x, s.y + d.dy AS y
    FROM stones s CROSS JOIN {_SIDES} AS d(dx, dy)""",
    "liberty_cells": f"{SIZED} SELECT board_id, bid, uid, x, y FROM free",
    "liberty_counts": f"{SIZED} SELECT board_id, bid, uid, liberties FROM sizes",
    "weighted_liberties": f"{SIZED} SELECT board_id, bid, uid, liberties * stones AS weighted FROM sizes",
    "dead_related": f"{MERGED} SELECT board_id, bid, uid, side FROM doomed",
    "need_clear": f"""{MERGED} SELECT t.board_id,
      EXISTS (SELECT 1 FROM doomed d WHERE d.board_id = t.board_id)::BIGINT AS need FROM top t""",
    "dead_blocks": f"{SIZED} SELECT board_id, bid FROM sizes WHERE liberties = 0",
    "sweep_removed": f"""{SIZED} SELECT s.{_COLUMNS.replace(', ', ', s.')} FROM stones s
      JOIN sizes z USING (board_id, bid) WHERE z.liberties = 0""",
    "sweep_kept": f"""{SIZED} SELECT s.{_COLUMNS.replace(', ', ', s.')} FROM stones s
      JOIN sizes z USING (board_id, bid) WHERE z.liberties > 0""",
    "block_labels": f"{STONES} SELECT board_id, id, bid FROM stones",
    "merged_labels": f"{MERGED} SELECT {_COLUMNS} FROM merged",
    "captured_by_last": f"""{MERGED} SELECT {_COLUMNS} FROM merged m WHERE EXISTS (
      SELECT 1 FROM doomed d WHERE d.board_id = m.board_id AND d.bid = m.bid AND d.side = 'enemy')""",
    "suicide_by_last": f"""{MERGED} SELECT {_COLUMNS} FROM kept k
      WHERE (board_id, bid) IN (SELECT (board_id, bid) FROM related2 WHERE side = 'own')
      AND NOT EXISTS (SELECT 1 FROM free2 f WHERE f.board_id = k.board_id AND f.bid = k.bid)""",
    "settled_boards": f"""{MERGED} SELECT {_COLUMNS} FROM kept k
      WHERE (board_id, bid) NOT IN (SELECT (board_id, bid) FROM related2 WHERE side = 'own')
      OR EXISTS (SELECT 1 FROM free2 f WHERE f.board_id = k.board_id AND f.bid = k.bid)""",
    "move_outcomes": _OUTCOMES,
    "move_captures": f"""{_CANDIDATES}
    SELECT concat_ws(',', m.x, m.y, m.uid) AS move_id, m.board_id, n.bid
    FROM moves m JOIN near n USING (board_id, x, y)
    JOIN sizes z ON z.board_id = n.board_id AND z.bid = n.bid
    WHERE z.uid <> m.uid AND z.liberties = 1 AND NOT EXISTS (
      SELECT 1 FROM stones s WHERE s.board_id = m.board_id AND s.x = m.x AND s.y = m.y)""",
    "replay_final": f"""{REPLAY},
    ends AS (SELECT board_id, unnest(st) AS s FROM played
             QUALIFY row_number() OVER (PARTITION BY board_id ORDER BY n DESC) = 1)
    SELECT board_id, s.id AS id, s.k // 100 - 1 AS x, s.k % 100 - 1 AS y, s.bid AS bid, s.uid AS uid FROM ends""",
    "replay_log": _REPLAY_LOG,
    "replay_on_stones_log": REPLAY_ON_STONES + """
    SELECT m.board_id, m.id, m.x, m.y, m.uid, p.outcome, p.captured, p.merged
    FROM played p JOIN moves m ON m.board_id = p.board_id AND m.n = p.n""",
    "block_by_code_removed": f"""{_CODED} SELECT {_COLUMNS} FROM coded
      WHERE (board_id, bid) IN (SELECT (board_id, bid) FROM hit)""",
    "block_by_code_kept": f"""{_CODED} SELECT {_COLUMNS} FROM coded
      WHERE (board_id, bid) NOT IN (SELECT (board_id, bid) FROM hit)""",
    "rect_by_code_removed": f"{_CODED} SELECT s.* FROM coded s JOIN code c USING (board_id) WHERE {_IN_CODE}",
    "rect_by_code_kept": f"{_CODED} SELECT s.* FROM coded s JOIN code c USING (board_id) WHERE NOT ({_IN_CODE})",
    "region_reset_kept": f"{STONES} SELECT {_COLUMNS} FROM stones WHERE NOT ({_IN_SQUARE})",
    "region_reset_removed": f"{STONES} SELECT {_COLUMNS} FROM stones WHERE {_IN_SQUARE}",
    "square_reset_kept": f"{STONES} SELECT {_COLUMNS} FROM stones WHERE NOT ({_IN_SQUARE})",
    "top_owners": f"""{STONES} SELECT uid, count(*) AS stones FROM stones GROUP BY uid
      ORDER BY stones DESC, uid LIMIT 100""",
    "minutes_since_last": """SELECT user_id AS board_id,
      ((epoch(TIMESTAMP '2024-03-01 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT) // 60)::BIGINT AS minutes
    FROM events GROUP BY user_id""",
    "minute_component": """SELECT user_id AS board_id,
      date_part('minute', TIMESTAMP '2024-03-01 00:00:00' - max(ts))::BIGINT AS minute
    FROM events GROUP BY user_id""",
    "idle_gaps": f"""{_MOVED} SELECT board_id, id, next_id, s AS idle_from, next_s AS idle_until,
      next_s - s AS gap FROM ahead WHERE next_s - s >= 1200""",
    "last_move_env": f"""{_ENV}
    SELECT board_id, 'system_start_time' AS name, strftime(t0, '%Y-%m-%d %H:%M:%S') AS value FROM ends
    UNION ALL SELECT board_id, 'last_go_time', strftime(t1, '%Y-%m-%d %H:%M:%S') FROM ends
    UNION ALL SELECT board_id, 'last_x', x::VARCHAR FROM ends
    UNION ALL SELECT board_id, 'last_y', y::VARCHAR FROM ends
    UNION ALL SELECT board_id, 'last_uid', uid::VARCHAR FROM ends""",
    "last_owner_setting": f"{_ENV} SELECT board_id, uid AS last_uid FROM ends",
    "stream_ingest": f"""{MOVES_JSON} SELECT board_id, x, y, id, uid FROM moves WHERE code = 0
      QUALIFY row_number() OVER (PARTITION BY board_id, x, y ORDER BY id) = 1""",
    "stream_idle_sessions": f"""{_MOVED},
    marked AS (
      SELECT *, sum(CASE WHEN prev_s IS NULL OR s - prev_s >= 1200 THEN 1 ELSE 0 END)
        OVER (PARTITION BY board_id ORDER BY s, id) AS session FROM ahead),
    sessions AS (
      SELECT board_id, session, min(s) AS started, max(s) AS ended, count(*) AS moves
      FROM marked GROUP BY ALL)
    SELECT board_id, started, ended, moves FROM sessions
    WHERE ended + 1199 <= (SELECT max(s) FROM moves)""",
    "stream_rejects": f"""{MOVES_JSON} SELECT board_id, id, code, 'not a move' AS reason
      FROM moves WHERE code <> 0""",
    "stream_replay_log": _REPLAY_LOG,
    "stream_replay_epochs_log": _REPLAY_LOG,
}
ORACLES["stream_replay_final"] = ORACLES["replay_final"]
ORACLES["rect_join_counts_small_tiles"] = ORACLES["rect_join_counts"]
ORACLES["block_labels_small_tiles"] = ORACLES["block_labels"]
ORACLES["stream_keyed_log"] = _REPLAY_LOG
ORACLES["stream_keyed_final"] = ORACLES["replay_final"]
ORACLES["stream_keyed_hot_log"] = f"""
    SELECT 0::BIGINT AS board_id, id, 20 * (board_id % 400) + 5 + x AS x,
      20 * (board_id // 400) + 5 + y AS y, uid, outcome, captured, merged
    FROM ({_REPLAY_LOG}) AS log"""

# The same fold, but a square is cleared before a move that comes after half a day.
_STEP = "FROM played p JOIN moves m ON m.board_id = p.board_id AND m.n = p.n + 1"
_CLEARED = """FROM (
  SELECT q.board_id, q.n, CASE WHEN r.idle >= 43200 THEN list_filter(q.st, lambda s: NOT (
      s.k // 100 - 1 BETWEEN 0 AND 2 AND s.k % 100 - 1 BETWEEN 0 AND 2)) ELSE q.st END AS st
  FROM played q JOIN moves r ON r.board_id = q.board_id AND r.n = q.n + 1) p
  JOIN moves m ON m.board_id = p.board_id AND m.n = p.n + 1"""


def _with_resets(sql: str) -> str:
    idle = "floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS idle,"
    return sql.replace(_STEP, _CLEARED).replace("row_number() OVER (PARTITION BY user_id", f"{idle} row_number() OVER (PARTITION BY user_id", 1)


ORACLES["stream_keyed_reset_log"] = _with_resets(_REPLAY_LOG)
ORACLES["stream_keyed_reset_final"] = _with_resets(ORACLES["replay_final"])


def _viewed(gone: str) -> str:
    """The stones of all batches but those that ``gone`` names, labelled and sized."""
    return f"""WITH RECURSIVE {PLACEMENTS},
    loaded AS MATERIALIZED (
      SELECT * FROM placements QUALIFY row_number() OVER (PARTITION BY board_id, x, y ORDER BY id) = 1),
    left_over AS MATERIALIZED (SELECT * FROM loaded WHERE NOT ({gone})),
    {_labelled("left_over", "viewed")}"""


_FIRST_GONE, _SECOND_GONE = "id % 3 = 0 AND id % 7 = 3", "id % 3 = 1 AND id % 7 = 5"
_VIEWED = _viewed(f"({_FIRST_GONE}) OR ({_SECOND_GONE})")
ORACLES |= {
    "view_stones": f"{_VIEWED} SELECT {_COLUMNS} FROM viewed",
    "view_stones_before": _viewed(f"({_FIRST_GONE}) OR id % 3 = 2") + f" SELECT {_COLUMNS} FROM viewed",
    "view_blocks": f"""{_VIEWED},
    qi AS (
      SELECT board_id, bid, count(*) AS qi FROM (
        SELECT DISTINCT v.board_id, v.bid, v.x + d.dx AS x, v.y + d.dy AS y
        FROM viewed v CROSS JOIN {_SIDES} AS d(dx, dy)) c
      WHERE NOT EXISTS (SELECT 1 FROM viewed o WHERE o.board_id = c.board_id AND o.x = c.x AND o.y = c.y)
      GROUP BY ALL)
    SELECT board_id, bid, uid, coalesce(qi, 0)::BIGINT AS qi
    FROM (SELECT DISTINCT board_id, bid, uid FROM viewed) b LEFT JOIN qi USING (board_id, bid)""",
    "view_poll": f"""{STONES}, {RECTS}
    SELECT r.request_id, s.id, s.x, s.y, s.uid, CASE WHEN s.id % 3 = 0 THEN -1 ELSE 1 END::BIGINT AS change,
      r.board_id
    FROM rects r JOIN stones s ON s.board_id = r.board_id
      AND s.x BETWEEN r.x1 AND r.x2 AND s.y BETWEEN r.y1 AND r.y2
    WHERE ({_FIRST_GONE}) OR s.id % 3 = 2 OR (s.id % 3 = 1 AND s.id % 7 <> 5)""",
}
