"""Garbled text from a wrong character encoding: expectation-maximization over latent encoding chains.

Every record has a latent chain: clean, or "bytes of one encoding read in another" (once or twice), or "bytes that were no UTF-8
replaced by U+FFFD". Evidence comes from the record's words with a character beyond ASCII: for each word and chain, how much likelier a
character model of clean text finds the restored word. A word may have escaped the damage, so a record's evidence for a chain is
the product of mixtures of both. Priors of the chains are kept by source and field.

The E-step gives each record's posterior; the M-step recounts the character model on restored words by their posteriors and the
priors by source and field. Weak evidence is thus pooled: a chain found plainly in some records of a source makes it likelier in
others, and damaged words stop counting as clean ones.

The texts are cut into words in the JVM, twice: once for the table of distinct words, once for (record, word) pairs. All else works on
these: chains are undone once for each distinct word, and a round is joins and sums of words, pairs and priors. What goes to the
driver is bounded: hashed n-gram counts (:data:`TRI` + :data:`BI` + :data:`UNI` numbers).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.runtime import materialize, spread

TRI, BI, UNI = 1 << 21, 1 << 18, 1 << 14
#: Share of a damaged record's words taken to be damaged, and the prior of all chains together before the first round.
DAMAGED_WORDS, FIRST_PRIOR = 0.5, 0.05
#: Evidence (in nats) for a word with U+FFFD in it.
LOST_EVIDENCE = 9.0
#: Restorations that lose more than this (in nats) say nothing for their chain.
MOST_LOSS = 2.0
#: Words that may be damaged, and damaged records, that are broadcast at most to find them in the texts; more are joined by shuffle.
MAX_BROADCAST = 1_000_000
LOST = "lost"

#: Encodings that bytes are wrongly read in, and encodings the bytes were really in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp932", "euc_jp", "gb18030")


def all_chains() -> list[str]:
    """Names of all chains: ``written>read``, and ``written>read x2`` where UTF-8 went wrong twice."""
    once = [f"{w}>{r}" for r in READ_AS for w in WRITTEN_IN if w != r]
    return once + [f"utf-8>{r} x2" for r in ("cp1252", "latin-1", "mac_roman")]


_TABLES: dict[str, dict[str, int]] = {}


def byte_table(encoding: str) -> dict[str, int]:
    """Character -> byte of a one-byte encoding; a byte it leaves undefined stands for the C1 control of its number, as lenient
    readers give it."""
    if encoding in _TABLES:
        return _TABLES[encoding]
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    _TABLES[encoding] = table = {chr(b): b for b in range(0x80, 0xA0)} | table
    return table


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that were read in ``encoding``; None where it lacks a character of the text."""
    table = byte_table(encoding)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def from_utf8(chars: str, raw: bytes) -> str:
    """``chars`` with each whole multi-byte UTF-8 sequence among their bytes ``raw`` (one for each character, 0 where a character
    is not from the read encoding) decoded; all else stays."""
    out, i, n = [], 0, len(raw)
    while i < n:
        b = raw[i]
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
        if size > 1 and i + size <= n:
            try:
                out.append(raw[i : i + size].decode())
                i += size
                continue
            except UnicodeDecodeError:
                pass
        if raw[i : i + 2] == b"\xe2\x80" and chars[i + 1 : i + 2] == "€":
            # The third byte of a closing quote is undefined where the second reads "€": lenient readers drop it.
            out.append("”")
            i += 2
            continue
        out.append(chars[i])
        i += 1
    return "".join(out)


def loose_bytes(text: str, encoding: str) -> bytes:
    """One byte for each character: as :func:`to_bytes`, 0 for characters that the encoding lacks."""
    table = byte_table(encoding)
    return bytes([table.get(c, 0) for c in text])


_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")
#: A first and a second byte of a multi-byte UTF-8 sequence, or what is left of a closing quote.
_UTF8_START = re.compile(rb"[\xc2-\xf4][\x80-\xbf]")


def _clean(before: str, text: str) -> str | None:
    return None if before == text or _CONTROL.search(before) else before


def undo(text: str, chain: str) -> str | None:
    """The text before ``chain`` damaged it, wholly or (UTF-8) in places; None where the chain can't have given this text or changes
    nothing."""
    way, _, twice = chain.partition(" x")
    written, read = way.split(">")
    if written == "utf-8":
        before = from_utf8(text, loose_bytes(text, read))
        if twice and before != text:
            again = from_utf8(before, loose_bytes(before, read))
            return None if again == before else _clean(again, text)
        return None if twice else _clean(before, text)
    raw = to_bytes(text, read)
    if raw is None:
        return None
    try:
        return _clean(raw.decode(written), text)
    except UnicodeDecodeError:
        return None


def by_reading(chains: list[str]) -> list[tuple[str, list[str], list[tuple[str, str]]]]:
    """(read, chains from UTF-8, (chain, written) of the others) for each encoding that is read in."""
    out: dict[str, tuple[list[str], list[tuple[str, str]]]] = {}
    for chain in chains:
        written, read = chain.partition(" x")[0].split(">")
        own = out.setdefault(read, ([], []))
        if written == "utf-8":
            own[0].append(chain)
        else:
            own[1].append((chain, written))
    return [(read, a, b) for read, (a, b) in out.items()]


def all_undone(text: str, readings: list[tuple[str, list[str], list[tuple[str, str]]]]) -> list[tuple[str, str]]:
    """(chain, restored) for each chain that can have given the text: as :func:`undo` on each, reading each encoding once."""
    out = []
    for read, from_utf, others in readings:
        loose = loose_bytes(text, read)
        if from_utf and _UTF8_START.search(loose):
            for chain in from_utf:
                if (restored := undo(text, chain)) is not None:
                    out.append((chain, restored))
        if 0 in loose and (raw := to_bytes(text, read)) is None:
            continue
        raw = loose
        for chain, written in others:
            try:
                restored = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if restored != text and not _CONTROL.search(restored):
                out.append((chain, restored))
    return out


def words_of(text: str) -> list[str]:
    """Runs without ASCII white space that hold a character beyond ASCII."""
    return [w for w in re.findall(r"[^ \t\r\n]+", text) if not w.isascii()]


def words_in(text: Column) -> Column:
    """:func:`words_of` in the JVM."""
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: F.octet_length(w) != F.length(w))


def parts_of(word: str) -> list[str]:
    """A word cut where letters of ideographic or kana scripts meet others: damage may begin or end within unspaced text."""
    return re.findall(r"[⺀-鿿豈-￯]+|[^⺀-鿿豈-￯]+", word)


def _flat_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams, bigrams, characters, word starts): hashed, for each place in all words set one after the other, each with two marks in
    front and one behind. At place i begin the trigram and the bigram; a word's last two and last one are of no use."""
    low = ["\x02\x02" + w.lower() + "\x03" for w in words]
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    c = np.frombuffer(re.sub(r"\d", "0", "".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mask, nxt = np.uint64(0xFFFFFFFF), np.concatenate([c[1:], c[:1]])
    bi = (c * np.uint64(0x9E3779B1) + nxt * np.uint64(0x85EBCA6B)) & mask
    tri = ((bi ^ (bi >> np.uint64(15))) * np.uint64(0x2C1B3C6D) + np.concatenate([nxt[1:], nxt[:1]]) * np.uint64(0x297A2D39)) & mask
    tri, bi = (tri ^ (tri >> np.uint64(13))) % np.uint64(TRI), (bi ^ (bi >> np.uint64(16))) % np.uint64(BI)
    return tri.astype(np.int64), bi.astype(np.int64), (c % np.uint64(UNI)).astype(np.int64), starts


class Model:
    """Character model of clean text (interpolated trigrams), and the priors of the chains: a table (grp, chain, prior)."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray, uni: np.ndarray, chains: list[str], priors: DataFrame | None = None) -> None:
        self.tri, self.bi, self.uni, self.chains, self.priors = tri, bi, uni, chains, priors
        self.total = float(uni.sum()) + 1.0
        self.tables: WordTables | None = None

    def log_ps(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words."""
        if not words:
            return np.zeros(0)
        t, b, u, starts = _flat_grams(words)
        u_next = np.concatenate([u[1:], u[:1]])
        p1 = (self.uni[u_next] + 0.05) / (self.total + 0.05 * UNI)
        before = self.uni[u].astype(np.float64)
        before[starts[:-1]] = self.total
        p2 = (self.bi[b] + 2.0 * p1) / (np.maximum(before, self.bi[b]) + 2.0)
        p3 = (self.tri[t] + np.concatenate([p2[1:], p2[:1]])) / (np.maximum(self.bi[b], self.tri[t]) + 1.0)
        logs = np.log(p3)
        logs[starts[1:] - 1] = logs[starts[1:] - 2] = 0
        return np.add.reduceat(logs, starts[:-1])

    def log_p(self, word: str) -> float:
        return float(self.log_ps([word])[0])


def candidates(word: str, readings: list, known: np.ndarray) -> list[tuple[str, str]]:
    """(chain, restored word) for the chains that can have given the word. ``known``: whether a character occurs in the texts at all; a
    byte-for-byte chain that makes up others explains nothing."""
    if "�" in word:
        return [(LOST, word)]
    found = dict(all_undone(word, readings))
    if len(ps := parts_of(word)) > 1:
        for p in ps:
            if not p.isascii():
                for chain, restored in all_undone(p, readings):
                    found.setdefault(chain, word.replace(p, restored))
    return [(c, r) for c, r in found.items() if c.startswith("utf-8") or all(known[ord(x) % UNI] for x in r.lower() if x > "\x7f" and x not in word)]


def gains(model: Model, words: list[str], found: list[list[tuple[str, str]]]) -> list[list[tuple[str, float, str]]]:
    """(chain, gain of the log likelihood, restored word) of each word's candidates, without those that lose too much."""
    flat = [r for own in found for _, r in own]
    own, then = model.log_ps(words), model.log_ps(flat)
    out, at = [], 0
    for p, pairs in zip(own, found):
        part = [(c, LOST_EVIDENCE if c == LOST else float(then[at + k] - p), r) for k, (c, r) in enumerate(pairs)]
        at += len(pairs)
        out.append([x for x in part if x[1] > -MOST_LOSS])
    return out


class WordTables:
    """What the texts are to the rounds. ``words``: (word, n). ``pairs``: (h1, h2, grp, wid, n, copies) of words that may be damaged, by number, where
    h1 and h2 are hashes of a text and its group, so equal texts of one group are one record of several copies. ``sizes``: (grp, records)."""

    def __init__(self, docs: DataFrame) -> None:
        # A text without a character beyond ASCII has no word to look at.
        self.some = docs.filter(F.octet_length("text") != F.length("text")).select("grp", "text", *_text_key())
        self.words = materialize(self.some.select(F.explode(words_in(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
        self.sizes = materialize(docs.groupBy("grp").agg(F.count(F.lit(1)).alias("records")), "sizes")
        self.found: DataFrame | None = None
        self.pairs: DataFrame | None = None

    def find(self, model: Model) -> None:
        """``found``: (wid, word, chains, restored), the candidates of every word that has any."""
        share = self.words.sparkSession.sparkContext.broadcast((by_reading(model.chains), model.uni >= 1))

        def undo_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            readings, known = share.value
            for pdf in batches:
                rows = [(w, candidates(w, readings, known)) for w in pdf["word"]]
                yield pd.DataFrame([(w, [c for c, _ in x], [r for _, r in x]) for w, x in rows if x], columns=["word", "chains", "restored"])

        found = spread(self.words.select("word")).mapInPandas(undo_all, "word string, chains array<string>, restored array<string>")
        self.found = materialize(found.withColumn("wid", F.monotonically_increasing_id()), "found")
        # Only words with a candidate tell anything of a record.
        few = self.found.select("word", "wid")
        few = F.broadcast(few) if few.count() <= MAX_BROADCAST else few
        copies = self.some.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
        every = self.some.select("grp", "h1", "h2", F.explode(words_in(F.col("text"))).alias("word")).join(few, "word").drop("word")
        # The join by record lays the rows out as the sum by record and word needs them.
        every = every.join(copies, ["h1", "h2"]).groupBy("h1", "h2", "grp", "copies", "wid").agg(F.count(F.lit(1)).alias("n"))
        self.pairs = materialize(every.withColumn("n", F.col("n") / F.col("copies")), "pairs")


def _text_key() -> list[Column]:
    return [F.xxhash64("text", "grp").alias("h1"), F.xxhash64("grp", "text").alias("h2")]


def _word_gains(tables: WordTables, model: Model) -> DataFrame:
    """(wid, word, chain, gain, restored) under the model."""
    share = tables.words.sparkSession.sparkContext.broadcast((model.tri, model.bi, model.uni, model.chains))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*share.value)
        for pdf in batches:
            found = [list(zip(c, r)) for c, r in zip(pdf["chains"], pdf["restored"])]
            rows = [(i, w, *x) for i, w, own in zip(pdf["wid"], pdf["word"], gains(m, list(pdf["word"]), found)) for x in own]
            yield pd.DataFrame(rows, columns=["wid", "word", "chain", "gain", "restored"])

    return materialize(tables.found.mapInPandas(weigh, "wid long, word string, chain string, gain double, restored string"), "gains")


def _posteriors(tables: WordTables, model: Model, told: DataFrame) -> DataFrame:
    """(h1, h2, grp, copies, chain, p): the probability of each chain, given a record's words; what is missing to 1 is for clean.
    ``told``: the words' gains."""
    # Repeats of one word in one record are one find, told more than once.
    weight = (1 + F.log("n")) * F.log1p(F.lit(DAMAGED_WORDS) * (F.exp(F.least("gain", F.lit(60.0))) - 1))
    record = ["h1", "h2", "grp", "copies"]
    evidence = tables.pairs.join(told.select("wid", "chain", "gain"), "wid").groupBy(*record, "chain").agg(F.sum(weight).alias("e"))
    floor = FIRST_PRIOR / (20 * len(model.chains))
    if model.priors is None:
        logs = evidence.withColumn("x", F.col("e") + math.log(FIRST_PRIOR / (len(model.chains) + 1)))
    else:
        logs = evidence.join(model.priors, ["grp", "chain"], "left").withColumn("x", F.col("e") + F.log(F.greatest(F.coalesce("prior", F.lit(0.0)), F.lit(floor))))
    own = logs.groupBy(*record).agg(F.collect_list(F.struct("chain", "x")).alias("xs"))  # at most one entry for each chain
    own = own.withColumn("top", F.greatest(F.lit(0.0), F.array_max("xs.x")))
    own = own.withColumn("total", F.aggregate("xs", F.exp(-F.col("top")), lambda acc, y: acc + F.exp(y["x"] - F.col("top"))))
    return own.select(*record, "top", "total", F.explode("xs").alias("y")).select(*record, F.col("y.chain").alias("chain"), (F.exp(F.col("y.x") - F.col("top")) / F.col("total")).alias("p"))


def _counted(weighted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram tables of weighted words: (word, w)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {"tri": np.zeros(TRI), "bi": np.zeros(BI), "uni": np.zeros(UNI)}
        for pdf in batches:
            t, b, u, starts = _flat_grams(list(pdf["word"]))
            w = np.repeat(pdf["w"].to_numpy(), np.diff(starts))
            ends = starts[1:]
            for name, keys, cut in (("tri", t, (ends - 1, ends - 2)), ("bi", b, (ends - 1,)), ("uni", u, (starts[:-1],))):
                own = w.copy()
                for x in cut:
                    own[x] = 0
                tables[name] += np.bincount(keys, own, len(tables[name]))
        for name, x in tables.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"kind": name, "key": at.astype(np.int32), "n": x[at]})

    sums = spread(weighted).mapInPandas(count, "kind string, key int, n double").groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()  # bounded: hashed buckets
    out = []
    for name, size in (("tri", TRI), ("bi", BI), ("uni", UNI)):
        x, own = np.zeros(size, np.float32), sums[sums["kind"] == name]
        x[own["key"].to_numpy(np.int64)] = own["n"]
        out.append(x)
    return tuple(out)


def _next(tables: WordTables, model: Model) -> Model:
    """One round: the posteriors under ``model``, and the model recounted by them."""
    told = _word_gains(tables, model)
    post = materialize(_posteriors(tables, model, told), "posteriors")
    found = tables.sizes.crossJoin(tables.sizes.sparkSession.createDataFrame([(c,) for c in [*model.chains, LOST]], "chain string"))  # groups and chains
    found = found.join(post.groupBy("grp", "chain").agg(F.sum(F.col("p") * F.col("copies")).alias("m")), ["grp", "chain"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    base = found.groupBy("chain").agg(((F.sum("m") + FIRST_PRIOR / len(model.chains)) / (F.sum("records") + 1)).alias("base"))
    # A group's own rates, drawn to the rates of all groups as if 50 records more had been seen.
    priors = found.join(base, "chain").select("grp", "chain", ((F.col("m") + 50 * F.col("base")) / (F.col("records") + 50)).alias("prior"))
    # Of a damaged record's words those that its chain makes likelier count as restored.
    hit = F.col("n") * F.col("copies") * F.col("p") / (1 + F.exp(-F.least(F.greatest("gain", F.lit(-60.0)), F.lit(60.0))))
    moved = tables.pairs.join(post.filter("p > 1e-3").select("h1", "h2", "chain", "p"), ["h1", "h2"]).join(told, ["wid", "chain"]).groupBy("word", "chain", "restored").agg(F.sum(hit).alias("w"))
    moved = materialize(moved, "moved")
    gone = moved.select("word", (-F.col("w")).alias("w"))
    come = moved.filter(F.col("chain") != LOST).select(F.col("restored").alias("word"), "w")
    weighted = tables.words.select("word", F.col("n").cast("double").alias("w")).unionByName(gone).unionByName(come).groupBy("word").agg(F.sum("w").alias("w")).filter("w > 1e-3")
    return Model(*_counted(weighted), model.chains, materialize(priors, "priors"))


def fit(docs: DataFrame, *, rounds: int = 2, chains: list[str] | None = None, text: str = "text", source: str = "source", field: str = "doc_kind") -> Model:
    """The model after ``rounds`` rounds of expectation and maximization over all records of ``docs``.

    Priors are kept by source and, where ``docs`` has the column, field; both are compared without case, blanks and the kind of dash.
    Null and empty texts say nothing.
    """
    tables = WordTables(_texts(docs, text, source, field))
    names = chains or all_chains()
    model = Model(*_counted(tables.words.select("word", F.col("n").cast("double").alias("w"))), names)
    tables.find(model)
    for _ in range(rounds):
        model = _next(tables, model)
    model.tables = tables
    return model


def _texts(docs: DataFrame, text: str, source: str, field: str) -> DataFrame:
    """(doc_id, text, grp) of the records with a text."""
    plain = lambda c: F.coalesce(F.regexp_replace(F.lower(F.trim(F.col(c).cast("string"))), r"[\s-]+", "_"), F.lit(""))
    grp = F.concat_ws("|", plain(source), plain(field) if field in docs.columns else F.lit(""))
    return docs.select("doc_id", F.col(text).alias("text"), grp.alias("grp")).filter("text is not null and text != ''")


def _fill_lost(model: Model, word: str) -> str:
    """The word with each U+FFFD replaced by the letter that the model finds likeliest, where it is far likelier than the next."""
    letters = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßąćęłńóśźżœ’“”«»„…—°£¿¡ÀÁÂÄÇÈÉÊËÍÑÓÖØÚÜ"
    while (at := word.find("�")) >= 0:
        tried = sorted(zip(model.log_ps([word[:at] + c + word[at + 1 :].replace("�", "") for c in letters]).tolist(), letters), reverse=True)
        if tried[0][0] - tried[1][0] < 1.0:
            return word
        word = word[:at] + tried[0][1] + word[at + 1 :]
    return word


def damaged(docs: DataFrame, model: Model, *, least: float = 0.5, text: str = "text", source: str = "source", field: str = "doc_kind") -> DataFrame:
    """(doc_id, text, chain, probability) of the records whose posterior of any damage is at least ``least``, with the likeliest chain."""
    own = _texts(docs, text, source, field)
    tables = model.tables
    if tables is None:
        tables = WordTables(own)
        tables.find(model)
    post = _posteriors(tables, model, _word_gains(tables, model))
    best = F.max(F.struct("p", "chain"))["chain"].alias("chain")
    bad = materialize(post.groupBy("h1", "h2").agg(F.sum("p").alias("probability"), best).filter(F.col("probability") >= least), "damaged")
    few = F.broadcast(bad) if bad.count() <= MAX_BROADCAST else bad
    return own.select("doc_id", "text", *_text_key()).join(few, ["h1", "h2"]).select("doc_id", "text", "chain", "probability")


def restore(docs: DataFrame, model: Model, *, text: str = "text", source: str = "source", field: str = "doc_kind", least: float = 0.5) -> DataFrame:
    """(doc_id, chain, probability, restored, text_restored) of the records whose posterior of any damage is at least ``least``.

    ``model``: of :func:`fit` on ``docs``. The likeliest chain repairs each word it makes likelier; the rest of the text stays as it is.
    ``restored`` is true where no U+FFFD is left and a word changed. Null, empty and clean texts have no row; equal texts of one source
    and field get equal results; other columns are ignored.
    """
    share = docs.sparkSession.sparkContext.broadcast((model.tri, model.bi, model.uni, model.chains))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*share.value)
        readings, known = by_reading(m.chains), m.uni >= 1
        for pdf in batches:
            rows = []
            for doc, text, chain, p in zip(pdf["doc_id"], pdf["text"], pdf["chain"], pdf["probability"]):
                words = sorted(set(words_of(text)))
                found = [[x for x in candidates(w, readings, known) if x[0] == chain] for w in words]
                best = {w: _fill_lost(m, w) if c == LOST else restored for w, own in zip(words, gains(m, words, found)) for c, gain, restored in own if gain > 0}
                fixed = re.sub(r"[^ \t\r\n]+", lambda x: best.get(x.group(), x.group()), text)
                rows.append((doc, chain, float(p), "�" not in fixed and fixed != text, fixed))
            yield pd.DataFrame(rows, columns=["doc_id", "chain", "probability", "restored", "text_restored"])

    hit = spread(damaged(docs, model, least=least, text=text, source=source, field=field))
    return hit.mapInPandas(repair, "doc_id long, chain string, probability double, restored boolean, text_restored string")
