import json

from pyspark.sql import functions as F

from tessera.sources.wire import envelope, parse_moves, parse_rect_requests


def parse(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    rows = sorted(parse_moves(df).collect(), key=lambda r: r.id)
    return [(r.x, r.y, r.uid) if r.code == 0 else None for r in rows]


def test_moves(spark):
    cases = {
        '{"x":1,"y":2,"uid":3}': (1, 2, 3),
        '{"x":-5,"Y":6,"UID":7}': (-5, 6, 7),
        "{}": (0, 0, 0),
        "null": (0, 0, 0),
        '{"x":null,"z":"?"}': (0, 0, 0),
        '{"uid":4294967040}': (0, 0, 4294967040),
        '{"x":-0}': (0, 0, 0),
        '{"x":1} trailing': (1, 0, 0),
        **{f'{{"x":1,"{n}":3}}': (1, 0, 3) for n in ("uId", "UId", "uiD", "uID", "UiD", "Uid", "UID")},
        '{"x":null,"X":5}': (5, 0, 0),
        '{"X":5,"x":null}': (5, 0, 0),
        '{"x":1,"X":2}': (2, 0, 0),
        '{"X":2,"x":1}': (1, 0, 0),
        '{"UID":1,"uid":2,"uId":3,"Uid":null}': (0, 0, 3),
        '{"x":1,"X":"2"}': None,
        '{"x":"1"}': None,
        '{"x":1.5}': None,
        '{"x":1.0}': None,
        '{"y":1e2}': None,
        '{"uid":true}': None,
        '{"x":[1]}': None,
        '{"x":{"a":1}}': None,
        '{"x":99999999999999999999}': None,
        "[]": None,
        "5": None,
        '"x"': None,
        "": None,
        "{bad": None,
        '{"x":1,"x":2}': None,
    }
    assert parse(spark, cases) == list(cases.values())
    assert parse(spark, [None]) == [None]


def rects(spark, queries):
    df = spark.createDataFrame(list(enumerate(queries)), "request_id long, qs string")
    rows = sorted(parse_rect_requests(df).collect(), key=lambda r: r.request_id)
    return [(r.x1, r.y1, r.x2, r.y2) if r.code == 0 else r.msg for r in rows]


def test_rect_requests(spark):
    cases = {
        "x1=1&x2=2&y1=-3&y2=4": (1, -3, 2, 4),
        "y2=4&y1=-3&x2=2&x1=1&x1=9&other": (1, -3, 2, 4),
        "x1=%2B1&x2=2&y1=0&y2=%34": (1, 0, 2, 4),
        "%781=1&x2=2&y1=0&y2=4": (1, 0, 2, 4),
        "": "no x1",
        "x2=2&y1=0&y2=1": "no x1",
        "xx1=1&x2=2&y1=0&y2=1": "no x1",
        "x1&x2=2&y1=0&y2=1": "x1 not int",
        "x1=&x2=2&y1=0&y2=1": "x1 not int",
        "x1=1=2&x2=2&y1=0&y2=1": "x1 not int",
        "x1=+1&x2=2&y1=0&y2=1": "x1 not int",
        "x1=1": "no x2",
        "x1=1&x2=b": "x2 should be int",
        "x1=1&x2=1.5": "x2 should be int",
        "x1=1&x2=99999999999999999999": "x2 should be int",
        "x1=1&x2=2&y2=1": "no y1",
        "x1=1&x2=2&y1=z&y2=1": "y1 should be int",
        "x1=1&x2=2&y1=0": "no y2",
        "x1=1&x2=2&y1=0&y2=0x1": "y2 should be int",
        "x1=1&x2=1&y1=0&y2=1": "x1<x2",
        "x1=1&x2=2&y1=1&y2=1": "y1<y2",
        "x1=3&x2=2&y1=5&y2=1": "x1<x2",
        "x1=1;x2=2": "invalid semicolon separator in query",
        "x1=%zz&x2=2": 'invalid URL escape "%zz"',
        "x1=1&x2=%4": 'invalid URL escape "%4"',
    }
    assert rects(spark, cases) == list(cases.values())
    assert rects(spark, [None]) == ["no x1"]


def test_envelope(spark):
    df = spark.createDataFrame([(0, "OK"), (-1, "no x1")], "code long, msg string")
    docs = [json.loads(r.body) for r in envelope(df).orderBy(F.desc("code")).collect()]
    assert docs == [
        {"code": 0, "msg": "OK", "data": []},
        {"code": -1, "msg": "no x1", "data": []},
    ]
