"""Five-field cron expressions as sets of numbers, for matching days with columns.

Lists, ranges, steps (``N/step`` runs to the maximum), ``L`` as day of month, ``D#O`` (the O-th weekday D of
the month), names JAN-DEC and SUN-SAT, 0 and 7 both Sunday. With day of month and day of week both not ``*``,
a day matches either.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
DAYS = {d: i for i, d in enumerate("SUN MON TUE WED THU FRI SAT".split())}


class CronError(ValueError):
    """The expression is outside the grammar."""


@dataclass(frozen=True)
class Cron:
    """Times of day in minutes; weekdays with Monday as 0."""

    times: tuple[int, ...]
    doms: tuple[int, ...]
    dom_last: bool
    dom_any: bool
    months: tuple[int, ...]
    dows: tuple[int, ...]
    nths: tuple[tuple[int, int], ...]
    dow_any: bool

    def row(self) -> tuple:
        return (list(self.times), list(self.doms), self.dom_last, self.dom_any, list(self.months), list(self.dows),
                [tuple(x) for x in self.nths], self.dow_any)


#: The same as a Spark type.
CRON_TYPE = ("times array<int>, doms array<int>, dom_last boolean, dom_any boolean, months array<int>, dows array<int>, "
             "nths array<struct<dow:int,n:int>>, dow_any boolean")


def _number(text: str, names: dict[str, int]) -> int:
    if text.upper() in names:
        return names[text.upper()]
    if not re.fullmatch(r"\d{1,2}", text):
        raise CronError(f"'{text}' is not a number")
    return int(text)


def _values(field: str, lo: int, hi: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for part in field.split(","):
        body, slash, step = part.partition("/")
        if slash and not (step.isdigit() and int(step) > 0):
            raise CronError(f"bad step in '{part}'")
        if body == "*":
            a, b = lo, hi
        elif "-" in body:
            a, b = (_number(x, names) for x in body.split("-", 1))
        else:
            a = _number(body, names)
            b = hi if slash else a
        if not lo <= a <= hi or not lo <= b <= hi or a > b:
            raise CronError(f"'{part}' is out of range {lo}-{hi}")
        out.update(range(a, b + 1, int(step) if slash else 1))
    return out


def parse_cron(expression: str) -> Cron:
    fields = expression.split()
    if len(fields) != 5:
        raise CronError(f"expected 5 fields, got {len(fields)}")
    minute, hour, dom, month, dow = fields
    times = sorted(h * 60 + m for h in _values(hour, 0, 23, {}) for m in _values(minute, 0, 59, {}))
    dom_parts = dom.split(",")
    doms = _values(",".join(p for p in dom_parts if p.upper() != "L"), 1, 31, {}) if any(p.upper() != "L" for p in dom_parts) else set()
    nths, plain = [], []
    for part in dow.split(","):
        if "#" in part:
            day, _, n = part.partition("#")
            if n not in {"1", "2", "3", "4", "5"}:
                raise CronError(f"bad occurrence in '{part}'")
            nths.append(((_number(day, DAYS) + 6) % 7, int(n)))
        else:
            plain.append(part)
    if nths and plain:
        raise CronError("plain days of week can't be mixed with '#'")
    dows = {(d + 6) % 7 for d in _values(",".join(plain), 0, 7, DAYS)} if plain else set()
    return Cron(tuple(times), tuple(sorted(doms)), any(p.upper() == "L" for p in dom_parts), dom == "*",
                tuple(sorted(_values(month, 1, 12, MONTHS))), tuple(sorted(dows)), tuple(nths), dow == "*")
