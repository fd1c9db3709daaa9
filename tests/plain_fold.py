"""Plain-Python statement of the rules, for comparison only."""


def around(c):
    x, y = c
    return [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]


def block_of(state, c):
    """Cells that share the label of the stone on ``c``."""
    label = state[c][2]
    return {k for k, s in state.items() if s[2] == label}


def has_liberty(state, cells):
    return any(n not in state for c in cells for n in around(c))


def step(state, move, label=None):
    """Play one move on ``{(x, y): (id, uid, bid)}``; returns its log entry."""
    mid, x, y, uid = move
    c = (x, y)
    if not (-10000 <= x <= 10000 and -10000 <= y <= 10000):
        return ("out_of_range", 0, False)
    if c in state:
        return ("occupied", 0, False)
    state[c] = (mid, uid, mid if label is None else label)
    own = {state[n][2] for n in around(c) if n in state and state[n][1] == uid}
    if own:
        low = min(own | {state[c][2]})
        for k, (i, u, b) in list(state.items()):
            if b in own or k == c:
                state[k] = (i, u, low)
    near = [n for n in around(c) if n in state and state[n][1] != uid]
    doomed = set()
    for n in near:
        cells = block_of(state, n)
        if not has_liberty(state, cells):
            doomed |= cells
    for k in doomed:
        del state[k]
    cells = block_of(state, c)
    if has_liberty(state, cells):
        return ("placed", len(doomed), bool(own))
    for k in cells:
        del state[k]
    return ("suicide", len(doomed), bool(own))


def play(moves, state=None, next_label=False):
    state = {} if state is None else state
    log = {}
    for m in sorted(moves):
        label = max((b for _, _, b in state.values()), default=0) + 1 if next_label else None
        log[m[0]] = step(state, m, label)
    return state, log
