"""License scans by patience alignment of texts with license templates.

Text and template become lower-cased words.  Where enough of a template's words stand
within a stretch of the text, the stretch and the template are aligned: words unique to
both are anchors, the longest increasing subsequence of them is kept, and the gaps
between anchors are aligned in the same way.  Coverage is the share of the template's
words that are aligned.

A share alone does not name a license: of templates below ``SHORT`` words every word must
be there, those from the license's name on next to each other; of headers (below ``HEADER`` words) the
share holds for their numbers and names too.  Among longer texts the more complete wins.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.license_texts import RETITLED, TEMPLATES

_WORD = re.compile(r"[^\W_]+")
#: Templates below this many words are notices, which need all of their words.
SHORT = 20
#: Words that stand before the license's name in a notice.
LEAD = frozenset("a is licensed released the this under work".split())
#: Templates below this many words name their license in few places, all of which count.
HEADER = 200
#: The first word of a source file tag, and what may follow its identifier in a longer one.
TAG = "spdx"
_GOES_ON = re.compile(r"[-.+]*\w|\+")
#: Words that, besides numbers, name a license.
NAMES = frozenset("affero apache lesser mozilla".split())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        if at:
            back[i] = piles[at - 1]
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of two short lists."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each beginning of ``b``, bit-parallel."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rest = full
    for w in a:
        hit = rest & places.get(w, 0)
        rest = (rest + hit | rest - hit) & full
    bits = np.unpackbits(np.frombuffer(rest.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common_long(a: list[str], b: list[str], small: int) -> list[tuple[int, int]]:
    """Longest common subsequence in linear space: halves of ``a`` against the best cut of ``b``."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        if i == n or j == m:
            continue
        if n - i == 1:
            out += [(i, b.index(a[i], j, m))] if a[i] in b[j:m] else []
        elif (n - i) * (m - j) <= small:
            out += [(i + x, j + y) for x, y in _common(a[i:n], b[j:m])]
        else:
            half = (i + n) // 2
            cut = j + int(np.argmax(_lengths(a[i:half], b[j:m]) + _lengths(a[half:n][::-1], b[j:m][::-1])[::-1]))
            todo += [(i, half, j, cut), (half, n, cut, m)]
    return out


def align(a: list[str], b: list[str], small: int = 4096) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), by anchors and recursion.  A gap without words unique
    to both sides is aligned by its longest common subsequence, in linear space if it has
    more than ``small`` pairs of places."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        count_a, count_b = Counter(a[i:n]), Counter(b[j:m])
        place = {w: k for k, w in enumerate(b[j:m], j) if count_b[w] == 1}
        both = [(k, place[w]) for k, w in enumerate(a[i:n], i) if count_a[w] == 1 and w in place]
        if both:
            anchors = [both[k] for k in increasing([y for _, y in both])]
            out += anchors
            ends = [(i - 1, j - 1), *anchors, (n, m)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
        else:
            out += [(i + x, j + y) for x, y in _common_long(a[i:n], b[j:m], small)]
    return sorted(out)


@dataclass
class Template:
    license: str
    words: list
    counts: Counter
    name: int = 0  # of a notice: place of the first word of the license's name
    telling: frozenset = frozenset()  # of a header: places of its numbers and names
    tag: bool = False  # an identifier, which must end where the template does


def templates(texts: dict[str, list[str]]) -> list[Template]:
    made = [Template(name, w, Counter(w)) for name, each in texts.items() for t in each if (w := _WORD.findall(t.lower()))]
    for t in made:
        if len(t.words) < SHORT:
            t.tag = t.words[0] == TAG
            t.name = next((j for j, w in enumerate(t.words) if w not in LEAD), 0)
        else:
            if len(t.words) < HEADER:
                t.telling = frozenset(j for j, w in enumerate(t.words) if w[0].isdigit() or w in NAMES)
    return made


def _notices(words: list[str], t: Template, room: int) -> list[tuple[int, int]]:
    """(first, last) word of each place of a notice: its name as it stands, and the words before it,
    in order, within ``room`` words."""
    name = t.words[t.name:]
    out: list[tuple[int, int]] = []
    free = 0
    for start in [i for i, w in enumerate(words) if w == name[0]]:
        if words[start:start + len(name)] != name:
            continue
        last = start + len(name) - 1
        floor = max(free, last + 1 - room)
        for w in reversed(t.words[:t.name]):
            start = next((k for k in range(start - 1, floor - 1, -1) if words[k] == w), -1)
            if start < 0:
                break
        else:
            out.append((start, last))
            free = last + 1
    return out


def _told(pairs: list[tuple[int, int]], t: Template, min_coverage: float) -> bool:
    return sum(j in t.telling for _, j in pairs) >= min_coverage * len(t.telling) - 1e-9


def _starts(words: list[str], t: Template, need: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, held): where a place can start -- at a word of the template that leaves ``need`` words,
    with at least ``need`` of its words, counted as often as it has them, in the next ``room``."""
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in t.counts:
            where.setdefault(w, []).append(i)
    none = np.zeros(0, np.int64)
    if sum(min(len(p), t.counts[w]) for w, p in where.items()) < need:
        return none, none
    starts = np.array(sorted(i for w in set(t.words[:len(t.words) - need + 1]) for i in where.get(w, ())), np.int64)
    held = np.zeros(len(starts), np.int64)
    for w, p in where.items():
        p = np.array(p)
        held += np.minimum(np.searchsorted(p, starts + room) - np.searchsorted(p, starts), t.counts[w])
    return starts[held >= need], held[held >= need]


def _aligned(words: list[str], start: int, room: int, end: int, template: list[str]) -> list[tuple[int, int]]:
    """Alignment of a stretch before ``end``, moved to start at its first aligned word while that aligns more."""
    best: list[tuple[int, int]] = []
    while True:
        pairs = [(start + i, j) for i, j in align(words[start:min(start + room, end)], template)]
        if len(pairs) <= len(best):
            return best or pairs
        best, start = pairs, pairs[0][0]


def _tight(words: list[str], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The first and last aligned words where they stand closest to the others."""
    if len(pairs) < 2:
        return pairs
    (i, j), (n, m) = pairs[0], pairs[-1]
    i = next(k for k in range(pairs[1][0] - 1, i - 1, -1) if words[k] == words[i])
    n = next(k for k in range(pairs[-2][0] + 1, n + 1) if words[k] == words[n])
    return [(i, j), *pairs[1:-1], (n, m)]


def _places(words: list[str], t: Template, need: int, room: int, min_coverage: float) -> list[list[tuple[int, int]]]:
    """Alignments that do not overlap, with at least ``need`` words.  After a place, what lies before
    it and behind it is searched too.  A stretch moved by d words aligns at most d more, so
    one that lacks d words is moved by d."""
    starts, held = _starts(words, t, need, room)
    out: list[list[tuple[int, int]]] = []
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        k = int(np.searchsorted(starts, lo))
        while k < len(starts) and (s := int(starts[k])) + need <= hi:
            pairs = _aligned(words, s, room, hi, t.words)
            if len(pairs) < need or not _told(pairs, t, min_coverage):
                k = int(np.searchsorted(starts, s + max(1, need - len(pairs))))
                continue
            upto = int(np.searchsorted(starts, pairs[-1][0]))
            most = k + np.flatnonzero(held[k:upto] == held[k:upto].max())  # a stray word may have begun it too early
            tries = [pairs, *(_aligned(words, int(starts[x]), room, hi, t.words) for x in {int(most[0]), int(most[-1])})]
            pairs = max((p for p in tries if _told(p, t, min_coverage)), key=lambda p: (len(p), p[0][0] - p[-1][0]))
            pairs = _tight(words, pairs)
            out.append(pairs)
            todo += [(pairs[-1][0] + 1, hi), (lo, pairs[0][0])]
            break
    return out


def scan(text: str | None, known: list[Template], min_coverage: float) -> list[tuple[str, int, int, float, int]]:
    """(license, start, end, coverage, words) of each place in a text, in order; start and end are
    code points.  Of places that overlap, that with the most aligned words stays, then
    the greater coverage, then the license that sorts first."""
    spans = [(m.start(), m.end()) for m in _WORD.finditer(text or "")]
    lowered = [text[i:j].lower() for i, j in spans]
    have = set(lowered)
    found = []
    for t in known:
        room = len(t.words) + len(t.words) // 2 + 4
        if len(t.words) < SHORT:
            if t.counts.keys() <= have:
                found += [(t.license, spans[i][0], spans[j][1], 1.0, len(t.words)) for i, j in _notices(lowered, t, room)
                          if not t.tag or not _GOES_ON.match(text, spans[j][1])]
            continue
        need = int(np.ceil(min_coverage * len(t.words) - 1e-9))
        if len(lowered) < need or len(t.counts) - len(have.intersection(t.counts)) > len(t.words) - need:
            continue
        for pairs in _places(lowered, t, need, room, min_coverage):
            i, j = pairs[0][0], pairs[-1][0]
            found.append((t.license, spans[i][0], spans[j][1], len(pairs) / len(t.words), len(pairs)))
    # kept places do not overlap, so only the neighbours of a place's start can overlap it
    kept: list = []
    for x in sorted(found, key=lambda x: (-x[4], -x[3], x[0], x[1])):
        at = bisect_left(kept, x[1], key=lambda y: y[1])
        if (at == 0 or kept[at - 1][2] <= x[1]) and (at == len(kept) or kept[at][1] >= x[2]):
            insort(kept, x, key=lambda y: y[1])
    return [_titled(x, text) for x in kept]


def _titled(place: tuple, text: str) -> tuple:
    """A whole text that begins with the title of another license, which shares it, is that license's."""
    for name, (of, title) in RETITLED.items():
        if place[0] == of and place[4] >= HEADER:
            head = [w.lower() for w in _WORD.findall(text[max(0, place[1] - 200):place[1] + 200])]
            words = _WORD.findall(title.lower())
            if any(head[i:i + len(words)] == words for i in range(len(head))):
                return (name, *place[1:])
    return place


def scan_licenses(docs: DataFrame, texts: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text",
                  min_coverage: float = 0.8) -> DataFrame:
    """Licenses of each whole text: (id, license, coverage, n_places, places).

    One row per input row.  ``places`` lists (license, start, end, coverage, words) in the order of the text;
    ``license`` is that of the place with the most aligned words (ties: greater coverage,
    then the first name), and null if there is none, as for null and empty texts.
    Templates below ``SHORT`` words count only whole, whatever ``min_coverage``.
    Templates without words are left out; no templates give no places.  Texts are read
    whole, and only stretches that hold enough of a template's words are aligned, which
    loses no place whose words stand within one and a half times the template's length."""
    known = templates(TEMPLATES if texts is None else texts)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    place = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                          T.StructField("coverage", T.DoubleType()), T.StructField("words", T.LongType())])
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("license", T.StringType()),
                           T.StructField("coverage", T.DoubleType()), T.StructField("n_places", T.LongType()),
                           T.StructField("places", T.ArrayType(place))])

    def find(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["places"].dataType)
        for b in batches:
            each = [scan(x, known, min_coverage) for x in b.column(1).to_pylist()]
            best = [min(p, key=lambda x: (-x[4], -x[3], x[0]), default=(None, 0, 0, None)) for p in each]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[3] for x in best], pa.float64()),
                 pa.array(list(map(len, each)), pa.int64()),
                 pa.array([[dict(zip(place.names, x)) for x in p] for p in each], kind)], names=schema.names)

    return rows.mapInArrow(find, schema)
