"""A structural index of many JSON documents at once, from the bytes of an Arrow string column.

Quotes, brackets, commas and colons are found by array operations over the whole buffer; depth is a running sum, a value's parent the
last bracket that opened one level above it. No document is read by itself: what comes out are arrays with one entry for each JSON
value, in the order of the documents, from which child lists, parent indices and texts are taken by offsets.

A document's JSON is its first ``{`` and all up to the bracket that closes it; text around it is skipped, and a document that breaks
off before has no values. The grammar is checked in the same way, by each token and the one before. Documents that fail a check, repeat
a member's name or lie deeper than :data:`MAX_DEPTH` are left to an ordinary parser (``rest``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliolake.functions.vlm_json import PAGE_MEMBERS, read_doc

MAX_DEPTH = 100
OBJECT, ARRAY, CLOSE_OBJECT, CLOSE_ARRAY, COMMA, COLON, STRING, LITERAL = range(1, 9)
_BLANK, _MARK, _QUOTE, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b" \t\r\n")] = _BLANK
_CLASS[list(b"{}[],:")] = _MARK
_CLASS[ord('"')] = _QUOTE
_KIND = np.full(256, LITERAL, np.uint8)
for _char, _code in zip(b'{[}],:"', (OBJECT, ARRAY, CLOSE_OBJECT, CLOSE_ARRAY, COMMA, COLON, STRING)):
    _KIND[_char] = _code
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_LITERAL_TEXT = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$"


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def place_in_group(groups: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal values."""
    n = len(groups)
    first = np.concatenate([[True], groups[1:] != groups[:-1]]) if n else np.zeros(0, bool)
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(first, at, 0)) if n else at


def column_bytes(docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if not pa.types.is_large_string(docs.type):
        docs = docs.cast(pa.large_string())
    if docs.null_count:
        docs = pc.fill_null(docs, "")
    offsets = np.frombuffer(docs.buffers()[1], np.int64, len(docs) + 1, docs.offset * 8)
    raw = docs.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class JsonIndex:
    """Arrays over all values: ``doc``, ``kind``, ``level``, ``parent`` (number of the value around it, -1 at the top), ``begin`` and
    ``end`` (bytes), ``stop`` (the values inside are the numbers up to it), ``key`` (number of the member's name in ``names``, -1 in a
    list), ``null``. ``root`` has a value's number for each document, -1 where there is none; ``rest`` marks documents that are left over."""

    def __init__(self, docs: pa.Array, max_depth: int = MAX_DEPTH, names_may_repeat: bool = False) -> None:
        self.buf, starts = column_bytes(docs)
        buf, n_docs = self.buf, len(docs)
        bad = np.zeros(n_docs, bool)

        def doc_at(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(starts, at, "right") - 1

        cls = _CLASS[buf]
        braces = np.flatnonzero(buf == ord("{"))
        nth = np.searchsorted(braces, starts[:-1])
        first = np.concatenate([braces, [len(buf)]])[nth] if n_docs else np.zeros(0, np.int64)
        first = np.minimum(first, starts[1:])
        cls[ranges(starts[:-1], first - starts[:-1])] = _BLANK
        # Of a run of backslashes every other one, from the first, escapes what follows it.
        slash = np.flatnonzero(buf == ord("\\"))
        run = np.concatenate([[0], np.cumsum(np.diff(slash) != 1)]) if len(slash) else slash
        escaping = slash[place_in_group(run) % 2 == 0]
        escaped = escaping[escaping + 1 < len(buf)] + 1
        cls[escaped[cls[escaped] == _QUOTE]] = _OTHER
        quotes = np.flatnonzero(cls == _QUOTE)
        per_doc = np.diff(np.searchsorted(quotes, starts))
        odd = per_doc % 2 == 1
        if odd.any():
            bad |= odd
            quotes = quotes[~np.repeat(odd, per_doc)]
            cls[ranges(starts[:-1][odd], np.diff(starts)[odd])] = _BLANK
        opens, closes = quotes[0::2], quotes[1::2]
        turn = np.zeros(len(buf) + 1, np.int8)
        turn[opens + 1] += 1
        turn[closes] -= 1
        inside = np.cumsum(turn[:-1], dtype=np.int8).view(bool)
        bad[doc_at(np.flatnonzero((buf < 32) & inside))] = True
        self.escaping = escaping[inside[escaping]]
        after = np.minimum(self.escaping + 1, len(buf) - 1)
        wrong = ~_ESCAPES[buf[after]]
        unicode = np.flatnonzero(buf[after] == ord("u"))
        digits = np.minimum(after[unicode][:, None] + np.arange(1, 5), len(buf) - 1)
        wrong[unicode] = ~_HEX[buf[digits]].all(axis=1)
        bad[doc_at(self.escaping[wrong])] = True

        word = (cls == _OTHER) & ~inside
        word_first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        word_end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
        token = (cls == _MARK) & ~inside
        token[opens] = True
        token[word_first] = True
        at = np.flatnonzero(token)
        kind = _KIND[buf[at]]
        doc = np.repeat(np.arange(n_docs), np.diff(np.searchsorted(at, starts)))
        step = np.zeros(9, np.int8)
        step[[OBJECT, ARRAY]], step[[CLOSE_OBJECT, CLOSE_ARRAY]] = 1, -1
        depth = np.cumsum(step[kind], dtype=np.int64)
        of_doc = np.searchsorted(doc, np.arange(n_docs))
        before = np.concatenate([[0], depth])[of_doc]
        depth -= before[doc]
        # A document ends where its depth first returns to nothing; what never ends is broken off.
        ends = np.flatnonzero(depth == 0)
        ends = ends[np.concatenate([[True], doc[ends][1:] != doc[ends][:-1]])] if len(ends) else ends
        last = np.full(n_docs, -1)
        last[doc[ends]] = ends
        keep = np.arange(len(at)) <= last[doc]
        at, kind, doc, depth = at[keep], kind[keep], doc[keep], depth[keep]
        opening, closing = (kind == OBJECT) | (kind == ARRAY), (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
        level = depth - opening
        if len(level) and level.max() > max_depth:
            deep = np.unique(doc[level > max_depth])
            bad[deep] = True
            ok = ~np.isin(doc, deep)
            at, kind, doc, level, opening, closing = (x[ok] for x in (at, kind, doc, level, opening, closing))
        n = len(at)
        parent, match = np.full(n, -1), np.full(n, -1)
        order = np.argsort(level.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(level[order], np.arange((level.max() if n else 0) + 2))
        above = np.zeros(0, np.int64)
        for d in range(len(cuts) - 1):
            own = order[cuts[d] : cuts[d + 1]]
            if d:
                parent[own] = above[np.searchsorted(above, own) - 1]
            above, shut = own[opening[own]], own[closing[own]]
            match[above] = shut
        pair = np.flatnonzero(opening)
        bad[doc[pair[kind[match[pair]] != kind[pair] + 2]]] = True

        was = np.concatenate([[0], kind[:-1]])[:n]
        top = level == 0
        in_object = ~top & (kind[parent] == OBJECT)
        is_key = (kind == STRING) & in_object & ((was == OBJECT) | (was == COMMA))
        value = (opening | (kind == LITERAL) | (kind == STRING)) & ~is_key
        done = ((kind == LITERAL) | (kind == STRING) | closing) & ~is_key
        after_value, after_key = np.concatenate([[False], done[:-1]])[:n], np.concatenate([[False], is_key[:-1]])[:n]
        right = np.where(value, top | np.where(in_object, was == COLON, (was == ARRAY) | (was == COMMA)), is_key)
        right |= (kind == COLON) & after_key | (kind == COMMA) & after_value
        right |= (kind == CLOSE_OBJECT) & (after_value | (was == OBJECT)) | (kind == CLOSE_ARRAY) & (after_value | (was == ARRAY))
        bad[doc[~right]] = True

        end = at + 1
        texts = kind == STRING
        end[texts] = closes[np.searchsorted(opens, at[texts])] + 1
        words = np.flatnonzero(kind == LITERAL)
        end[words] = word_end[np.searchsorted(word_first, at[words])]
        end[opening] = at[match[opening]] + 1
        literal = self._slices(at[words], end[words])
        bad[doc[words[~pc.match_substring_regex(literal, _LITERAL_TEXT).to_numpy(zero_copy_only=False)]]] = True

        keys = np.flatnonzero(is_key)
        coded = self._texts(at[keys] + 1, end[keys] - 1).dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        key_of = np.full(n, -1)
        key_of[keys] = coded.indices.to_numpy()
        named = np.flatnonzero(value & in_object)
        named = named[named >= 2]
        if not names_may_repeat:
            pairs = np.stack([parent[named], key_of[named - 2], named])
            pairs = pairs[:, np.lexsort(pairs[:2])]
            twice = (pairs[0, 1:] == pairs[0, :-1]) & (pairs[1, 1:] == pairs[1, :-1])
            bad[doc[pairs[2, 1:][twice]]] = True

        chosen = np.flatnonzero(value & ~bad[doc])
        number = np.full(n + 1, -1)
        number[chosen] = np.arange(len(chosen))
        self.doc, self.kind, self.level, self.begin, self.end = doc[chosen], kind[chosen], level[chosen], at[chosen], end[chosen]
        self.parent = number[parent[chosen]]
        self.parent[self.level == 0] = -1
        self.key = np.where(in_object[chosen], key_of[np.maximum(chosen - 2, 0)], -1)
        self.stop = np.searchsorted(self.begin, self.end)
        self.null = (self.kind == LITERAL) & (buf[self.begin] == ord("n"))
        self.root = np.full(n_docs, -1)
        tops = np.flatnonzero(self.level == 0)
        self.root[self.doc[tops]] = tops
        self.rest = bad
        leaf = ((self.kind == STRING) | (self.kind == LITERAL)) & ~self.null
        self.leaves = np.flatnonzero(leaf)
        self.leaves_before = np.concatenate([[0], np.cumsum(leaf)])

    def _slices(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        lengths = end - begin
        data = self.buf[ranges(begin, lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data))

    def _texts(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The strings written between the bytes; only those with an escape in them are decoded."""
        out = self._slices(begin, end)
        hit = np.searchsorted(self.escaping, begin) != np.searchsorted(self.escaping, end)
        if not hit.any():
            return out
        raw = out.filter(pa.array(hit)).to_pylist()
        try:
            plain = pa.array(json.loads('["' + '","'.join(raw) + '"]'), pa.large_string())
        except (ValueError, UnicodeEncodeError):  # of documents that are left over, or half a surrogate pair
            plain = pa.array([_decoded(x) for x in raw], pa.large_string())
        return pc.replace_with_mask(out, pa.array(hit), plain)

    def children(self, of: np.ndarray) -> np.ndarray:
        """Numbers of the values directly in those marked by ``of`` (a truth value for each value), in order."""
        at = np.flatnonzero(self.parent >= 0)
        return at[of[self.parent[at]]]

    def strings(self, values: np.ndarray) -> pa.Array:
        """The texts of string values."""
        return self._texts(self.begin[values] + 1, self.end[values] - 1)

    def written(self, values: np.ndarray) -> pa.Array:
        """The values as they are written."""
        return self._slices(self.begin[values], self.end[values])

    def flat_texts(self, values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
        """For each owner 0 .. n - 1 the strings, numbers and truth values in its values, joined by blanks; ``owner`` is in order."""
        low, high = self.leaves_before[values], self.leaves_before[self.stop[values]]
        leaves = self.leaves[ranges(low, high - low)]
        text = self.kind[leaves] == STRING
        words = self._texts(self.begin[leaves] + text, self.end[leaves] - text)
        counts = np.bincount(owner, weights=high - low, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, words), pa.scalar(" ", pa.large_string())).cast(pa.string())

    def codes(self, names: frozenset | tuple | list) -> np.ndarray:
        """Truth value for each number of a name: whether it is one of ``names``. A last entry stands for values without a name."""
        return np.array([x in names for x in self.names] + [False])

    def first_named(self, of: np.ndarray, names: tuple[str, ...], *, nulls: bool = False) -> np.ndarray:
        """For each value the number of its member of the first of ``names`` that it has (not null unless ``nulls``), else -1."""
        out = np.full(len(self.doc), -1)
        place = np.array([names.index(x) if x in names else len(names) for x in self.names] + [len(names)])
        own = self.children(of)
        rank = place[self.key[own]]
        ok = (rank < len(names)) & (nulls | ~self.null[own])
        own, rank = own[ok], rank[ok]
        # Written from the last choice to the first, so the first stays.
        by = np.lexsort([own, -rank])
        out[self.parent[own[by]]] = own[by]
        return out


def _decoded(raw: str) -> str:
    try:
        return json.loads(f'"{raw}"').encode("utf-8", "replace").decode()
    except ValueError:
        return raw


def indexed(docs: pa.Array) -> tuple[JsonIndex, JsonIndex | None, np.ndarray]:
    """(index, index of the rest, numbers of the rest): documents that the first index leaves over are parsed one by one, and those that
    hold an object are written anew and indexed in turn."""
    whole = JsonIndex(docs)
    numbers = np.flatnonzero(whole.rest)
    if not len(numbers):
        return whole, None, numbers
    pages = [read_doc(x) for x in docs.take(pa.array(numbers)).to_pylist()]
    numbers = numbers[[p is not None for p in pages]]
    again = [json.dumps(p) for p in pages if p is not None]
    return whole, JsonIndex(pa.array(again, pa.large_string()), max_depth=1 << 15) if again else None, numbers


def panel_lists(ix: JsonIndex) -> np.ndarray:
    """For each value, if it is a page: the number of its panel list (as ``vlm_json.panel_list``), -1 where there is none."""
    inner = np.zeros(len(ix.doc), bool)
    objects = np.flatnonzero((ix.kind == OBJECT) & (ix.parent >= 0))
    inner[ix.parent[objects]] = True
    members = np.flatnonzero((ix.level == 1) & ~ix.codes(PAGE_MEMBERS)[ix.key])
    out = np.full(len(ix.doc), -1)
    spare = members[ix.null[members] | (ix.kind[members] == OBJECT) | (ix.kind[members] == ARRAY)]
    # Written from the last to the first, so the first stays; those that hold objects come before all others.
    for own in (spare, members[inner[members]]):
        out[ix.parent[own[::-1]]] = own[::-1]
    return out


def pieces(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of a string column, of one row at least."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < batch.num_rows:
        hi = int(min(max(np.searchsorted(upto, upto[lo] + size, "right") - 1, lo + 1), batch.num_rows))
        yield batch.slice(lo, hi - lo)
        lo = hi
