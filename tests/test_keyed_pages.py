"""How often a keyed board looks into the state store, and what it finds there again."""

import random

from plain_fold import play
from pyspark.sql import Row

from tessera.streaming.keyed import BoardPlayer, IdleReset

MOVE = Row("id", "x", "y", "uid", "reason", "at")


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Store:
    """The state of one key; counts the looks into its maps."""

    def __init__(self):
        self.maps, self.looks = [], 0

    def getMapState(self, *_):
        store, kept = self, {}

        class Map:
            def getValue(self, key):
                store.looks += 1
                return kept.get(key)

            def updateValue(self, key, value):
                store.looks += 1
                kept[key] = value

            def removeKey(self, key):
                store.looks += 1
                del kept[key]

        self.maps.append(kept)
        return Map()

    def getValueState(self, *_):
        return Value()


def played(moves, batches, reset=None):
    store, player = Store(), BoardPlayer(reset=reset)
    player.init(store)
    size = -(-len(moves) // batches)
    events = []
    for k in range(0, len(moves), size):
        events += map(tuple, player.handleInputRows((0, 0), iter(moves[k : k + size]), None))
    return store, events


def moves_on(size, n, seed, low=0):
    rng = random.Random(seed)
    return [
        MOVE(i + 1, low + rng.randrange(size), low + rng.randrange(size), rng.randrange(2), None, 100 * i + rng.randrange(150))
        for i in range(n)
    ]


def test_a_batch_looks_into_the_store_page_by_page():
    moves = moves_on(6, 120, 2)
    store, events = played(moves, 3)
    # Three pages are read, at most three written, by each of three batches.
    assert store.looks <= 18
    _, log = play([m[:4] for m in moves])
    taken = {i for i, e in log.items() if e[1] or e[0] == "suicide"}
    assert taken and {e[2] for e in events if e[4] in ("captured", "suicide")} == taken


def test_a_move_on_a_large_board_reads_what_is_beside_it():
    moves = [MOVE(i + 1, 10 * (i % 60), 10 * (i // 60), i % 2, None, None) for i in range(3000)]
    store, _ = played(moves, 1)
    before = store.looks
    player = BoardPlayer()
    assert len(store.maps[0]) > 1000
    player.init(store)
    player.pages = type("Kept", (), {
        "getValue": lambda self, key: (setattr(store, "looks", store.looks + 1), store.maps[0].get(key))[1],
        "updateValue": lambda self, key, value: store.maps[0].update({key: value}),
    })()
    list(player.handleInputRows((0, 0), iter([MOVE(5000, 105, 101, 1, None, None)]), None))
    assert store.looks - before <= 4


def test_blocks_across_pages_are_the_same_in_one_batch_and_in_many():
    """With resets, which cut blocks that reach over several pages, below zero, too."""
    for seed in range(4):
        moves = moves_on(22, 700, seed, low=-11)
        for reset in (None, IdleReset(-5, 6, 150)):
            (one, first), (many, second) = played(moves, 1, reset), played(moves, 23, reset)
            assert first == second
            assert any(e[4] == "reset" for e in first) == (reset is not None)
        state, _ = play([m[:4] for m in moves])
        _, events = played(moves, 23)
        gone = {e[8] for e in events if e[4] in ("captured", "suicide")}
        assert {e[8] for e in events if e[4] == "placed"} - gone == {s[0] for s in state.values()}
