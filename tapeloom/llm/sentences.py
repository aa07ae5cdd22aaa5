"""Problem 7: sentence boundaries across languages and scripts, by a maximum-entropy classifier.

Every cluster of end marks, with the closing quotes after it, is a candidate. Its features are the tokens beside it, their case,
length, digits and script, and the quotation or parenthesis it stands in. The classifier is a logistic regression trained on
reliable boundaries: in texts laid out one sentence a line, line ends are boundaries and marks inside a line are none.
The token before a mark is looked for in 24 characters; one of over six can't be an abbreviation by itself, whatever it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import bounded_sample, each

#: The end marks. Fixed values.
MARKS = ".!?…。！？।؟"
#: Closing signs for each opening sign. Fixed values.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
#: Common abbreviations that a period belongs to. Fixed values.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof rev st sr jr sra dra srta vs etc cf vol no nos p pp fig approx ca e.g i.e a.m p.m hr fr nr bd s usw z.b d.h bzw evtl vgl abs "
    "m mme mlle t chap env p.ex c.-à-d pág págs núm aprox ej p.ej ud uds т.е т.д др г гг тыс стр им см डॉ श्री د".split()
)
#: What a number with a period before it is a date with, where ordinals are written so. Fixed values.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember marts maj".split())
#: Texts the classifier is trained on, at most; the rows with the least hash of their key are taken.
TRAINING_TEXTS = 3000
#: Straight quotes open and close alike; from so many characters on one is taken for unclosed. Paired signs are matched at any distance.
LONGEST_STRAIGHT = 600

_MARK = re.compile(f"[{re.escape(MARKS)}]+")
_EVENT = re.compile(f'[{re.escape(MARKS)}]+|["“”„«»「」『』()（）\\[\\]]')
_TOKEN = re.compile(r'[^\s"“„«(\[「『（¿¡—–]*\Z')
_LINE = re.compile(r"[^\r\n]+")
_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"[^\W\d_]+")
_SHORT = 6

Features = tuple[str, ...]


def _kind(text: str, at: int) -> str:
    """What stands at ``at``: end, lower or upper letter, letter without case, digit, or a sign and what follows it."""
    signs = ""
    while at < len(text):
        c = text[at]
        if c.islower():
            return signs + "l"
        if c.isupper():
            return signs + "u"
        if c.isdigit():
            return signs + "d"
        if c.isalpha():
            return signs + "o"
        if c.isspace():
            if not signs:
                return "x"
        elif signs:
            return signs + "x"
        elif c in "—–-":
            signs = "h"
        elif c in '"“„«「『¿¡(（[':
            signs = "q"
        elif c in ",;:、，；：،؛":
            return "p"
        else:
            return "x"
        at += 1
    return "e"


def _quotes(text: str, events: list[tuple[int, int, str]]) -> dict[int, int]:
    """The closing place of every opening sign that is closed, by its own place."""
    closed: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for at, _, sign in events:
        if sign[0] in MARKS:
            continue
        while stack and stack[-1][0] == '"' and at - stack[-1][1] > LONGEST_STRAIGHT:
            stack.pop()
        match = next((i for i in range(len(stack) - 1, -1, -1) if sign in CLOSING[stack[i][0]]), None)
        if match is not None:
            closed[stack[match][1]] = at
            del stack[match:]
        elif sign in CLOSING:
            stack.append((sign, at))
    return closed


def candidates(text: str) -> Iterator[tuple[int, int, Features]]:
    """For each cluster of end marks: its place, where the next sentence would start, and its features."""
    events = [(m.start(), m.end(), m.group()) for m in _EVENT.finditer(text)]
    signs = any(sign[0] not in MARKS for _, _, sign in events)
    closed = _quotes(text, events) if signs else {}
    closers = set(closed.values())
    case = "m" if not text.islower() and not text.isupper() else "l" if text.islower() else "u"
    open_now: list[int] = []
    for at, end, sign in events:
        if sign[0] not in MARKS:
            if at in closers:
                while open_now and closed[open_now[-1]] <= at:
                    open_now.pop()
            elif at in closed:
                open_now.append(at)
            continue
        after, left, shut = end, len(open_now), 0
        while True:
            if after in closers:
                after, left, shut = after + 1, left - 1, 1
            elif after + 1 < len(text) and text[after] in " \xa0 " and text[after + 1] == "»" and after + 1 in closers:
                after, left, shut = after + 2, left - 1, 1
            else:
                break
        start = _SPACE.match(text, after).end()
        kind = _kind(text, start)
        if left > 0:
            outer = open_now[0]
            bracket = "b" if text[outer] in "([（" else "q"
            where = f"in{bracket}{_kind(text, _SPACE.match(text, closed[outer] + 1).end())}"
        else:
            where = "shut" if shut else "out"
        mark = sign[0] if len(sign) == 1 or sign.strip(".") else "..."
        mark = {"!": "?", "！": "？", "…": "..."}.get(mark, mark)
        gap = "" if kind not in ("l", "d", "x") and (kind, where) != ("o", "shut") else "0" if start == after else "1"
        before = _TOKEN.search(text, max(0, at - 24), at).group().lower()
        if "." in before and len(before.rpartition(".")[0]) > 3:
            before = before.rpartition(".")[2]
        known = "a" if before in ABBREVIATIONS else "-"
        if mark == "." and before.isdecimal() and len(before) <= 2:
            token, shape = "#", "9"
            if (word := _WORD.match(text, start)) and word.group().lower() in MONTHS:
                known = "o"
        else:
            token = before if mark == "." and len(before) <= _SHORT else "*"
            shape = "0" if not before else "9" if before[-1].isdigit() else "1" if len(before) == 1 else "i" if "." in before else "w"
        yield at, start, (mark, token, shape, kind + gap, where, case, known)


def _facets(f: Features) -> tuple[str, ...]:
    """The features as the classifier weighs them: alone and in conjunctions."""
    mark, token, shape, kind, where, case, known = f
    return (
        "bias",
        f"1{mark}",
        f"2{mark}|{kind}",
        f"3{where}|{kind}",
        f"4{where}|{mark}",
        f"5{token}",
        f"6{token}|{kind}",
        f"7{shape}|{mark}|{kind}",
        f"8{known}|{kind}",
        f"9{case}|{kind}",
        f"a{case}|{where}|{kind}|{mark}",
    )


def reliable(text: str) -> list[tuple[Features, bool]]:
    """The candidates of a text laid out one sentence a line, and whether each ends its line; of any other text none."""
    lines = [m for m in _LINE.finditer(text) if m.group().strip()]
    if len(lines) < 3:
        return []
    found = list(candidates(text))
    starts = {m.start() + len(m.group()) - len(m.group().lstrip()) for m in lines[1:]}
    if not starts <= {start for _, start, _ in found}:
        return []
    inner, kept = False, []
    for _, start, f in found:
        mark, token, shape, kind, where, _, known = f
        if start >= len(text.rstrip()):
            continue
        if start in starts:
            kept.append((f, True))
            continue
        inner = True
        if where in ("out", "shut") and kind in ("u", "o", "o1", "qu", "qo", "hu") and shape != "1" and known == "-":
            if mark != "." or token == "*":
                return []  # a line with several sentences
            continue  # an abbreviation that isn't known, or a sentence that ends in a short word
        kept.append((f, False))
    if not inner and any(f[6] == "a" for f, _ in kept):
        return []  # lines are also broken after abbreviations
    return kept


class Model:
    """Weights of the facets; a sum above 0 is a boundary."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._seen: dict[Features, bool] = {}

    def __reduce__(self):
        return Model, (self.weights,)

    def ends(self, f: Features) -> bool:
        known = self._seen.get(f)
        if known is None:
            if len(self._seen) > 500_000:
                self._seen.clear()
            known = self._seen[f] = sum(self.weights.get(x, 0.0) for x in _facets(f)) > 0
        return known


#: What a general belief weighs beside the list's: in all as much as a candidate that the texts show some thirty times.
GENERAL = 2.0

#: What is believed before any text is seen, as labelled candidates. Fixed values.
_BELIEFS = [
    ((mark, token, "w", kind, where, case, "-"), where != "in" and kind[-1] in ("u", "o", "e", "x"))
    for token in ("*", "~")
    for mark in (".", "?", "...", "。", "？", "।", "؟")
    for kind in ("u", "l1", "l0", "d0", "o", "hl", "hu", "p", "qu", "qo", "e")
    for where in ("out", "shut")
    for case in "m"
    if (kind, where) != ("o", "shut")
] + [
    *(((mark, "*", "w", kind, f"in{b}{then}", "m", "-"), False) for mark in (".", "?", "。", "？", "...") for kind in ("u", "o") for b in "qb" for then in ("l", "o", "p", "hl")),
    *(((mark, "*", "w", kind, f"inq{then}", "m", "-"), True) for mark in (".", "?", "。") for kind in ("u", "o") for then in ("u", "e", "qu")),
    *(((mark, "*", "w", f"o{gap}", "shut", "m", "-"), gap == "1") for mark in ("?", "？", "。", ".", "...") for gap in "01"),
    *(((".", token, "9", kind, "out", "m", "-"), kind == "u") for token in ("*", "~", "#") for kind in ("u", "l1", "d0")),
    *(((".", "#", "9", kind, where, case, "o"), False) for kind in ("u", "l1") for where in ("out", "shut") for case in "mul"),
    *(((".", a, "i" if "." in a else "1" if len(a) == 1 else "w", kind, "out", case, "a"), False) for a in sorted(ABBREVIATIONS) for kind in ("u", "l1", "d1", "o") for case in "mu"),
    *(((".", a, "i" if "." in a else "1" if len(a) == 1 else "w", kind, f"inb{then}", "m", "a"), False) for a in sorted(ABBREVIATIONS) for kind in ("l1", "d1") for then in ("l", "p", "x", "u", "e")),
    *(((".", "*", "1", kind, "out", "m", "-"), False) for kind in ("u", "l1", "d1")),
    *(((mark, "*", "w", kind, "out", "u", "-"), kind == "u") for mark in (".", "?", "...") for kind in ("u", "d0", "p")),
    *(((mark, "*", "w", "l1", "out", "l", "-"), True) for mark in (".", "?", "।")),
]


def trained(texts: list[str]) -> Model:
    """A model fitted to the reliable candidates of ``texts`` and, weakly, to what is believed beforehand."""
    counts: Counter[tuple[Features, bool]] = Counter(dict.fromkeys(_BELIEFS, 3))
    # An abbreviation is the exception: all that is believed of other words weighs as much as the list of abbreviations.
    general = {row for row in _BELIEFS if row[0][6] == "-"}
    for text in texts:
        counts.update(reliable(text))
    rows = list(counts)
    names = {x: i for i, x in enumerate(sorted({x for f, _ in rows for x in _facets(f)}))}
    at = np.array([[names[x] for x in _facets(f)] for f, _ in rows])
    y, n = np.array([1.0 if ends else 0.0 for _, ends in rows]), np.log1p(np.array([counts[r] for r in rows], dtype=float))
    n += np.array([GENERAL if r in general else 0.0 for r in rows])
    w, moved = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -30, 30)))
        slope = np.bincount(at.ravel(), weights=np.repeat(n * (p - y), at.shape[1]), minlength=len(w)) + 0.002 * w
        moved += slope**2
        w -= 0.5 * slope / np.sqrt(moved)
    return Model({x: float(w[i]) for x, i in names.items()})


def spans(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence in order: offsets of its first character that is no white space and of the end of its last one."""
    if not text or not text.strip():
        return []
    if not _MARK.search(text):
        return [(m.start() + len(m.group()) - len(m.group().lstrip()), m.start() + len(m.group().rstrip())) for m in _LINE.finditer(text) if m.group().strip()]
    cuts = [_SPACE.match(text).end()] + [start for _, start, f in candidates(text) if start < len(text) and model.ends(f)]
    ends = [*cuts[1:], len(text)]
    return [(a, a + len(text[a:b].rstrip())) for a, b in zip(cuts, ends) if b > a]


def fitted(df: DataFrame, key: str, text: str) -> Model:
    """A model for the texts of ``df``, from at most TRAINING_TEXTS of them: those with the least hash of their key."""
    kept = F.when(F.length(text).between(100, 20000), F.col(text)).alias("text")
    return trained(sorted({r.text for r in bounded_sample(df.select(F.col(key).alias("id"), kept).where("id IS NOT NULL"), "id", TRAINING_TEXTS) if r.text}))


def sentences(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(pos, n, start_at, end_at): the sentences of every text in order, with character offsets.

    NULL, empty and blank texts have none; rows with a NULL key are left out, as nothing names them. Repeated rows count
    once; of several texts under one key the one whose sentences sort last is taken. Other columns are not read.
    """
    model = model or fitted(df, key, text)

    def row(pos: int, value: str) -> Iterator[tuple]:
        found = spans(value, model)
        if found:
            yield pos, [a for a, _ in found], [b for _, b in found]

    rows = df.select(F.col(key).cast("long").alias("pos"), F.col(text).alias("text")).where("pos IS NOT NULL AND text IS NOT NULL")
    made = each(rows, "pos long, starts array<int>, ends array<int>", row)
    one = made.groupBy("pos").agg(F.max(F.struct("starts", "ends")).alias("s"))
    both = one.select("pos", F.posexplode(F.arrays_zip("s.starts", "s.ends")).alias("n", "x"))
    return both.select("pos", "n", F.col("x.starts").cast("long").alias("start_at"), F.col("x.ends").cast("long").alias("end_at"))
