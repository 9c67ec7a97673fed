"""Small SQL text helpers for the oracles."""

P = "PARTITION BY symbol ORDER BY ts"


def rows(n: int, part: str = P) -> str:
    return f"({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, col: str, n: int, part: str = P) -> str:
    """Rolling aggregate that is NULL until the frame holds ``n`` values."""
    w = rows(n, part)
    return f"CASE WHEN count({col}) OVER {w} = {n} THEN {fn}({col}) OVER {w} END"


def lag(col: str, n: int = 1, part: str = P) -> str:
    return f"lag({col}, {n}) OVER ({part})"


def recurrence(src: str, state: dict[str, tuple[str, str]], start: int = 0, keep: str = "") -> str:
    """CTE text ``numbered, rec``: ``state`` maps a name to (value at ``start``, next value).

    ``n`` is the current numbered row and ``r`` the previous state.
    """
    names = ", ".join(state)
    first = ", ".join(f"CAST({s[0]} AS DOUBLE)" for s in state.values())
    step = ", ".join(f"CAST({s[1]} AS DOUBLE)" for s in state.values())
    return f"""numbered AS (SELECT *, row_number() OVER ({P}) - 1 AS pos FROM ({src})),
        rec(symbol, ts, pos, {names}) AS (
            SELECT n.symbol, n.ts, n.pos, {first} FROM numbered n WHERE n.pos = {start}
            UNION ALL
            SELECT n.symbol, n.ts, n.pos, {step} FROM rec r JOIN numbered n
              ON n.symbol = r.symbol AND n.pos = r.pos + 1)"""


def ema_step(x: str, y: str, a: float) -> str:
    return f"{a!r}::DOUBLE * ({x}) + {1.0 - a!r}::DOUBLE * r.{y}"
