"""DuckDB SQL of the adapters and of the neighbourhood operators, for the oracles."""

from __future__ import annotations

from prismgrid.functions import color
from prismgrid.sources.raster import EVENT_TYPES

_KIND = " ".join(f"WHEN '{t}' THEN {51 * i}" for i, t in enumerate(EVENT_TYPES))
EVENTS = f"""SELECT CAST(0 AS BIGINT) AS frame_id, CAST(floor(event_id / 100e0) AS INT) AS y, CAST(event_id % 100 AS INT) AS x,
 {color.code('value / 490.02e0 * 255e0')} AS r, CAST(CASE event_type {_KIND} ELSE 0 END AS INT) AS g,
 CAST(event_id * 7919 % 256 AS INT) AS b FROM events"""
EMBEDDINGS = f"""SELECT CAST(0 AS BIGINT) AS frame_id, CAST(vec_id AS INT) AS y, CAST(x AS INT) AS x, CAST({color.code('128e0 + 400e0 * CAST(e AS DOUBLE)')} AS DOUBLE) AS v
 FROM (SELECT vec_id, unnest(range(64)) AS x, unnest(embedding) AS e FROM embeddings)"""
LINES = f"""SELECT {color.code('5e0 * l_quantity')} AS r, {color.code('l_discount * 2550e0')} AS g, {color.code('l_tax * 3187.5e0')} AS b FROM lineitem"""


def burst(frames: int = 5) -> str:
    return f"SELECT CAST(y % {frames} AS BIGINT) AS frame_id, CAST(floor(y / {float(frames)}e0) AS INT) AS y, x, v FROM ({EMBEDDINGS})"


def moved(dx: int, dy: int) -> str:
    return f"""SELECT CAST(0 AS BIGINT) AS frame_id, y, x, v FROM ({EMBEDDINGS}) UNION ALL
 SELECT CAST(1 AS BIGINT), t.y, t.x, s.v FROM (SELECT *, max(y) OVER () AS my, max(x) OVER () AS mx FROM ({EMBEDDINGS})) t
 JOIN ({EMBEDDINGS}) s ON s.y = least(greatest(t.y - {dy}, 0), t.my) AND s.x = least(greatest(t.x - {dx}, 0), t.mx)"""


class Steps:
    """Common table expressions in order."""

    def __init__(self, start: str):
        self.parts: list[str] = []
        self.last = self.add(start)

    def add(self, sql: str) -> str:
        name = f"s{len(self.parts)}"
        self.parts.append(f"{name} AS ({sql})")
        self.last = name
        return name

    def plus(self, columns: dict[str, str]) -> str:
        """The last step with more columns."""
        return self.add(f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {self.last}")

    def replace(self, columns: dict[str, str]) -> str:
        return self.add(f"SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in columns.items())}) FROM {self.last}")

    def drop(self, *names: str) -> str:
        return self.add(f"SELECT * EXCLUDE ({', '.join(names)}) FROM {self.last}")

    def join(self, sql: str, on: str = "frame_id") -> str:
        return self.add(f"SELECT * FROM {self.last} JOIN ({sql}) USING ({on})")

    def box(self, planes: dict[str, str], radius: int) -> str:
        self.plus(planes)
        for line, along in (("y", "x"), ("x", "y")):
            by = f"PARTITION BY frame_id, {line} ORDER BY {along}"
            every = f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            self.replace(
                {
                    n: f"(sum({n}) OVER ({by} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
                    f" + greatest(0, {radius} - {along}) * first_value({n}) {every}"
                    f" + greatest(0, {along} + {radius} - max({along}) {every}) * last_value({n}) {every}) / {2 * radius + 1}e0"
                    for n in planes
                }
            )
        return self.last

    def extreme(self, planes: dict[str, str], radius: int, pick: str = "max") -> str:
        self.plus(planes)
        for line, along in (("y", "x"), ("x", "y")):
            by = f"PARTITION BY frame_id, {line} ORDER BY {along} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
            self.replace({n: f"{pick}({n}) OVER ({by})" for n in planes})
        return self.last

    def guided(self, planes: dict[str, str], guide: str, radius: int, eps: float) -> str:
        first = {"mg_": guide, "gg_": f"{guide} * {guide}"}
        for i, (_, plane) in enumerate(planes.items()):
            first |= {f"m{i}_": plane, f"c{i}_": f"{plane} * {guide}"}
        self.box(first, radius)
        second = {}
        spread = "greatest(0e0, gg_ - mg_ * mg_)"
        for i in range(len(planes)):
            slope = f"((c{i}_ - m{i}_ * mg_) / ({spread} + {color.num(eps)}))"
            second |= {f"a{i}_": slope, f"b{i}_": f"m{i}_ - {slope} * mg_"}
        self.box(second, radius)
        self.plus({n: f"a{i}_ * {guide} + b{i}_" for i, n in enumerate(planes)})
        return self.drop(*first, *second)

    def done(self, sql: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + sql.replace("@", self.last)


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)
