"""License scan: winnowed fingerprints choose candidates, banded alignment measures them.

Words are compared without case and punctuation.  Each template's three-word
shingles are winnowed (the least hash of every ``WINDOW`` neighbours) into an
inverted index from hash to (template, place).  All shingles of a text are
looked up in it; each diagonal on which a template has hits is one candidate,
and the template is aligned with the words around it in a band.  A
candidate counts if enough of the template's words are matched; of overlapping
ones that with the most matched words stays (then the best covered).  Words that tell licenses apart (names, versions) must be
those of the template.  The index has a fixed size and each text is read by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .license_texts import TELLING

SHINGLE = 3
WINDOW = 4
BAND = 6                # words by which an alignment may leave its diagonal, besides a tenth of the template
COVERAGE = 0.8
SHORT = 10              # words of a template in which one altered word is all that the coverage allows
NOTICE = 60             # words of a notice, whose figures are versions; in longer texts they are clause numbers
MATCH, GAP = 2, -1
PIECE_BYTES = 1 << 20

PLAIN = np.arange(256) >= 0x80
PLAIN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word that has a letter or digit, its first byte and end in ``data``, and the number of words of each text."""
    kept = np.flatnonzero(PLAIN[data] | tb.SPACE[data])
    start, end, counts = tb.word_spans(data[kept], np.searchsorted(kept, offsets))
    hashes = tb.xxh64(tb.LOWER[data[kept]], start, end - start)
    return hashes, kept[start] if len(start) else start, kept[end - 1] + 1 if len(end) else end, counts


def _shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    with np.errstate(over="ignore"):
        if len(words) < size:
            return words[:0]
        h = np.full(len(words) - size + 1, size, np.uint64)
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j:len(words) - size + 1 + j]
    return tb.mixed(h)


@dataclass
class Index:
    """Words of each template, those it must keep, and the index: sorted hashes with the template and place of each."""

    names: list[str]
    words: list[np.ndarray]
    must: list[np.ndarray]
    telling: np.ndarray
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray

    def tells(self, t: int, rows: np.ndarray, words: np.ndarray, cells: np.ndarray) -> bool:
        """Whether the matched words have all that the template must keep, and no other telling word stands among them."""
        between = np.setdiff1d(np.arange(cells[0], cells[-1] + 1), cells)
        return bool(np.isin(self.must[t], rows).all()) and not np.isin(words[between], self.telling).any()


def _versions(text: str) -> np.ndarray:
    """Which words of a template have a digit."""
    return np.array([any(c.isdigit() for c in w) for w in text.split() if any(c.isalnum() for c in w)])


def index_of(templates: list[tuple[str, str]], telling: list[str] = TELLING) -> Index:
    """The index of ``templates``.  A match must keep the template's telling words and, in a notice of at most ``NOTICE``
    words, its version.  A template of fewer than ``SHORT`` words may have every shingle broken by one altered word,
    so its pairs of words are indexed that hold a word it must keep."""
    names, words, must, entries = [], [], [], []
    told = plain_words(*tb.buffers(pa.array([" ".join(telling)])))[0]
    for t, (name, text) in enumerate(templates):
        w = plain_words(*tb.buffers(pa.array([text])))[0]
        h = _shingles(w)
        if not len(h):
            raise ValueError(f"template of {name} has fewer than {SHINGLE} words")
        kept = np.flatnonzero(np.isin(w, told) | (_versions(text) if len(w) <= NOTICE else False))
        window = min(WINDOW, len(h))
        chosen = {int(a + np.argmin(h[a:a + window])) for a in range(len(h) - window + 1)}
        names.append(name)
        words.append(w)
        must.append(kept)
        entries += [(int(h[i]), t, i) for i in sorted(chosen)]
        if len(w) < SHORT:
            pairs = _shingles(w, 2)
            entries += [(int(pairs[i]), t, i) for i in range(len(pairs)) if i in kept or i + 1 in kept]
    entries.sort()
    return Index(names, words, must, told, np.array([e[0] for e in entries], np.uint64), np.array([e[1] for e in entries]), np.array([e[2] for e in entries]))


def align(template: np.ndarray, words: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of the template along the diagonal of ``words`` that begins at ``band``: the places of the
    matched words in the template and in ``words``; of equal alignments that which ends nearest to the diagonal.

    A row of the band is worked out at once: a run of words that the template lacks costs one GAP each, so
    the best way into a cell from its left is a running maximum."""
    rows, width = len(template), 2 * band + 1
    column = np.arange(width)
    off = np.abs(column - band)
    came = np.zeros((rows, width), np.int8)
    above = np.zeros(width + 1, np.int64)
    best = (0, 0, 0, width)
    for i in range(rows):
        here = min(width, len(words) - i)             # columns that have a word
        if here <= 0:
            break
        step = above[:here] + np.where(words[i:i + here] == template[i], MATCH, GAP)
        up = above[1:here + 1] + GAP
        open_ = np.maximum(np.maximum(step, up), 0)
        value = np.maximum.accumulate(open_ - GAP * column[:here]) + GAP * column[:here]
        came[i, :here] = np.where(value == 0, 0, np.where(value == step, 1, np.where(value == up, 2, 3)))
        top = int(value.max())
        if top and top >= best[0]:
            ends = np.flatnonzero(value == top)
            c = int(ends[np.argmin(off[ends])])
            if top > best[0] or off[c] < best[3]:
                best = (top, i, c, int(off[c]))
        above = np.zeros(width + 1, np.int64)
        above[:here] = value
    _, i, c, _ = best
    places = []
    while i >= 0 and c >= 0 and came[i, c]:
        if came[i, c] == 1:
            if template[i] == words[i + c]:
                places.append((i, i + c))
            i -= 1
        elif came[i, c] == 2:
            i, c = i - 1, c + 1
            if c >= width:
                break
        else:
            c -= 1
    found = np.array(places[::-1], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _candidates(template: np.ndarray, begin: np.ndarray) -> list[tuple[int, int]]:
    """Template and estimated first word of the hits, each once."""
    return [(int(t), int(at)) for t in np.unique(template) for at in np.unique(begin[template == t])]


def scan_text(words: np.ndarray, start: np.ndarray, end: np.ndarray, template: np.ndarray, begin: np.ndarray, index: Index) -> list[tuple]:
    """``(name, coverage, first byte, end)`` of the accepted, not overlapping matches of one text, in order."""
    found = []
    for t, at in _candidates(template, begin):
        wanted = index.words[t]
        band = BAND + len(wanted) // 10
        low = at - band
        around = words[max(low, 0):at + len(wanted) + band]
        if low < 0:                                    # words before the text, which match nothing
            around = np.concatenate([np.zeros(-low, np.uint64), around])
        rows, cells = align(wanted, around, band)
        matched = len(rows)
        if matched and matched >= COVERAGE * len(wanted) and index.tells(t, rows, around, cells):
            a, b = int(cells[0]), int(cells[-1]) + 1
            found.append((matched, matched / len(wanted), -t, max(low, 0) + a + min(low, 0), max(low, 0) + b + min(low, 0)))
    out: list[tuple] = []
    taken = np.zeros(len(words), bool)
    for _, coverage, t, a, b in sorted(found, reverse=True):
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((index.names[-t], coverage, int(start[a]), int(end[b - 1])))
    return sorted(out, key=lambda o: o[2:])


def scan(docs: DataFrame, templates: list[tuple[str, str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, matches)``, one row per row of ``docs``: ``matches`` are ``(license, coverage, start, end)`` in order of place.

    ``coverage`` is the matched share of the template's words (0.8 or more), places
    count code points, end exclusive.  Null and empty texts have no matches; repeated rows have the same.  Of templates
    that match equally many words of a passage the better covered one stays, then the first.
    Extra columns are not read; an empty table gives an empty one."""
    index = index_of(templates)
    kind = docs.schema[doc_id].dataType.simpleString()
    match = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(0))
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for a, b in tb.pieces(offsets, PIECE_BYTES):
                part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                words, start, end, counts = plain_words(part, off)
                sizes = [_shingles(words), _shingles(words, 2)]
                h = np.concatenate(sizes)
                first = np.searchsorted(index.hashes, h)
                hit = np.flatnonzero((first < len(index.hashes)) & (index.hashes[np.minimum(first, len(index.hashes) - 1)] == h))
                if not len(hit):
                    continue
                n = np.searchsorted(index.hashes, h[hit], "right") - first[hit]
                entry = np.arange(int(n.sum())) + np.repeat(first[hit] - (np.cumsum(n) - n), n)
                size = np.where(hit < len(sizes[0]), SHINGLE, 2)
                word = np.repeat(np.where(hit < len(sizes[0]), hit, hit - len(sizes[0])), n)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                owner = np.searchsorted(bounds, word, "right") - 1
                inside = word + np.repeat(size, n) <= bounds[owner + 1]          # a shingle must not reach into the next text
                word, entry, owner = word[inside], entry[inside], owner[inside]
                for o in np.unique(owner):
                    mine = owner == o
                    low, high = bounds[o], bounds[o + 1]
                    places = scan_text(words[low:high], start[low:high], end[low:high], index.template[entry[mine]],
                                       word[mine] - low - index.place[entry[mine]], index)
                    if places:
                        points = np.concatenate([[0], np.cumsum((part[off[o]:off[o + 1]] & 0xC0) != 0x80)])
                        found[a + o] = [{"license": name, "coverage": coverage, "start": int(points[x - off[o]]), "end": int(points[y - off[o]])}
                                        for name, coverage, x, y in places]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, match)], names=["doc_id", "matches"])

    return docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id")).mapInArrow(
        run, f"doc_id {kind}, matches array<struct<license:string,coverage:double,start:bigint,end:bigint>>")
