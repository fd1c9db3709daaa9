"""Fixed schemas and constants of the lattice data model.

Everything is keyed by ``board_id``: one board is one independent lattice.  All
keys and counts are 64-bit, because owner ids use the full unsigned 32-bit range.
"""

from pyspark.sql import types as T

# Fixed values.
COORD_MIN, COORD_MAX = -10000, 10000
BORDER_OWNER = 4294967040
IDLE_SECONDS = 1200
GRID_PIXELS = 25
CODE_BITS = 14

TILE = 64
"""Edge length of the square tiles the set-based operators partition a board by.
Cells are unique, so a tile never holds more than ``TILE * TILE`` stones."""


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


STONES = _longs("board_id", "id", "x", "y", "bid", "uid")
MOVES = _longs("board_id", "id", "x", "y", "uid").add("ts", T.TimestampNTZType())
MOVES_JSON = _longs("board_id", "id").add("body", T.StringType())
RECTS = _longs("request_id", "board_id", "x1", "y1", "x2", "y2")
RECT_REQUESTS = _longs("request_id", "board_id").add("qs", T.StringType())
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
