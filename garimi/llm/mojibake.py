"""Text garbled by a wrong decoding.

Every distinct clean word of the corpus is garbled under every encoding chain: its bytes in one
encoding read in another, once or twice, with undefined bytes kept, replaced or dropped. Forms that no
token can be are left out as they are made, by a filter of bounded size over the corpus's tokens; the
tokens of the documents are joined by hash against the table of the others. Because forms are generated and
not undone, chains that lose bytes are found and repaired as well. A match that chance could make is
verified by the corpus: the original must stand in at least as many distinct texts as the garbled form
does. A match beyond chance needs no counts, for a garbled source or a garbled text that is copied often
outnumbers the clean words; any other without them is repaired only where the rest of the document shows
the same chain.

A word is a longest run of characters outside ASCII: single-byte readings of UTF-8 or of the Korean code
page never leave that range, so runs are garbled whole. Words that occur nowhere clean (names, say) are
looked up character by character: a token that is, from end to end, made of garbled forms of clean
characters under one chain that loses nothing.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimi.llm.bloom import Bloom
from garimi.staging import spread, staged

#: Fixed encodings: those text is written in, and those it is wrongly read in.
WRITTEN = ("utf-8", "cp949")
SINGLE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "iso8859-5", "cp1253", "iso8859-7", "cp852", "cp1257", "mac_cyrillic")
MULTI_BYTE = ("cp949", "cp932", "shift_jis", "gbk", "big5", "euc_jp")
TWICE = ("cp1252", "latin-1")
RUN = r"[^\x00-\x7F]+"


def _kept(name: str) -> list[str]:
    """What each byte reads as, undefined ones as the control character of that number."""
    out = []
    for b in range(256):
        ch = bytes([b]).decode(name, "ignore")
        out.append(ch or chr(b))
    return out


@lru_cache(1)
def chains() -> dict[str, Callable[[str], str]]:
    """Name to garbling function; a function raises where the text has no bytes in the encoding."""
    out: dict[str, Callable[[str], str]] = {}

    def single(w: str, r: str, how: str) -> Callable[[str], str]:
        table = "".join(_kept(r))
        if how == "kept":
            return lambda s: codecs.charmap_decode(s.encode(w), "strict", table)[0]
        if how == "stripped":  # control characters lost on the way
            return lambda s: re.sub("[\x80-\x9f]+", "", codecs.charmap_decode(s.encode(w), "strict", table)[0])
        return lambda s: s.encode(w).decode(r, how)

    for w in WRITTEN:
        for r in SINGLE_BYTE:
            for how in ("kept", "stripped", "replace"):
                out[f"{w}>{r}:{how}"] = single(w, r, how)
        for r in MULTI_BYTE:
            if r != w:
                for how in ("replace", "ignore")[: 2 if (w, r) == ("utf-8", "cp949") else 1]:
                    out[f"{w}>{r}:{how}"] = lambda s, w=w, r=r, how=how: s.encode(w).decode(r, how)
    out["cp949>utf-8:replace"] = lambda s: s.encode("cp949").decode("utf-8", "replace")
    for w in WRITTEN:
        for a in TWICE:
            for b in TWICE:
                out[f"{w}>{a}>utf-8>{b}"] = lambda s, f=single(w, a, "kept"), g=single("utf-8", b, "kept"): g(f(s))
    return out


@lru_cache(1)
def inverses() -> dict[str, Callable[[str], str]]:
    """Name to the undoing of a chain that loses nothing; raises where the text isn't its result."""
    out = {}

    def undo(w: str, r: str) -> Callable[[str], str]:
        back = {c: b for b, c in enumerate(_kept(r))}
        return lambda s: bytes([back[c] for c in s]).decode(w)

    for w in WRITTEN:
        for r in SINGLE_BYTE:
            out[f"{w}>{r}:kept"] = undo(w, r)
        for r in MULTI_BYTE:
            if r != w:
                out[f"{w}>{r}:replace"] = lambda s, w=w, r=r: s.encode(r).decode(w)
        for a in TWICE:
            for b in TWICE:
                out[f"{w}>{a}>utf-8>{b}"] = lambda s, f=undo(w, a), g=undo("utf-8", b): f(g(s))
    return out


_MULTI = tuple(f">{r}:" for r in MULTI_BYTE)
_HANGUL = "^[가-힣]+$"
_BROKEN = r"[\x{80}-\x{9F}\x{FFFD}\x{E000}-\x{F8FF}]"
_COMMON = "".join(chr(c) for c in range(0xAC00, 0xD7A4) if len(chr(c).encode("euc_kr", "ignore")) == 2)  # the 2,350 syllables of KS X 1001
LONGEST_KEY = 60  # characters; a longer run goes by its digest, so that the table stays narrow
BATCH_CHARS = 100_000  # characters of words that are garbled at once; a longer run alone


def _each(words: list[str], garble: Callable[[str], str]) -> list[str | None]:
    """The form of each word, all garbled as one text of a line each; None where it has no bytes in the encoding."""
    try:
        out = garble("\n".join(words)).split("\n")
        if len(out) == len(words):
            return out
    except UnicodeError:
        if len(words) == 1:
            return [None]
    return [f for w in words for f in _each([w], garble)] if len(words) > 1 else [None]


def _hash(form: str) -> int:
    """The hash of a string that the engine's ``xxhash64`` gives."""
    return xxhash.xxh64_intdigest(form, 42)


def _forms(words: list[str], tokens: Bloom | None = None) -> Iterator[tuple[int, str, str]]:
    """Place of the word, garbled form and the first chain that makes it; with ``tokens`` only forms that may be one.

    A form of one character is kept only if it is all that a reading in pairs of bytes makes of a
    character; else bytes were lost beyond recognition. One that is nothing but replacement characters shows
    that text was garbled, but is no word's alone."""
    seen: set[tuple[int, int]] = set()
    korean = [i for i, w in enumerate(words) if w.encode("cp949", "ignore").decode("cp949") == w]
    for name, garble in chains().items():
        at = korean if name.startswith("cp949") else range(len(words))
        made = _each([words[i] for i in at], garble) if at else []
        hashes = [0 if f is None else _hash(f) for f in made]
        picked = range(len(made)) if tokens is None else np.flatnonzero(tokens.contains(np.array(hashes, np.uint64).view(np.int64)))
        for k in picked:
            form, i = made[k], at[k]
            if form is None or form == words[i] or (i, hashes[k]) in seen or not form or regex.search(r"[\x00-\x7f]", form):
                continue
            if name == "cp949>utf-8:replace" and "�" not in form and regex.search("[가-힣]", form):
                continue  # the word is garbled and the form its original
            if len(form) > 1 or form != "�" and any(m in name for m in _MULTI):
                seen.add((i, hashes[k]))
                yield i, form, name


def forms(word: str) -> dict[str, str]:
    """Garbled form of a word to the first chain that makes it."""
    return {form: name for _, form, name in _forms([word])}


def _key(run: str) -> str:
    """What a run is joined by: itself or, of a longer one, its digest, which is ASCII and so no run."""
    return run if len(run) <= LONGEST_KEY else hashlib.sha256(run.encode()).hexdigest()


def key(run: Column) -> Column:
    return F.when(F.length(run) <= LONGEST_KEY, run).otherwise(F.sha2(run, 256))


_LOST = re.compile("�+")


def _garbled_forms(tokens: Bloom):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["word"].str.len().cumsum() // BATCH_CHARS):
                words, docs = part["word"].tolist(), part["word_docs"].tolist()
                clean: dict[int, bool] = {}
                rows = []
                for i, form, name in _forms(words, tokens):
                    if i not in clean:
                        clean[i] = bool(regex.search(_HANGUL, words[i])) or undo(words[i]) is None
                    word = form if _LOST.fullmatch(form) else words[i]
                    rows.append((_key(form), _key(word), docs[i], clean[i], name))
                yield pd.DataFrame(rows, columns=["key", "word", "word_docs", "clean", "chain"])

    return run


# Least characters of a token that is undone without a clean word that explains it: two syllables of the Korean code
# page read as western text, and one and a half characters of UTF-8 read in pairs of bytes. Chance meets shorter ones.
LEAST_WESTERN, LEAST_PAIRED = 4, 3


def undo(token: str) -> tuple[str, str] | None:
    """Original and chain of a token that is, from end to end, garbled forms of single characters; by
    readings of UTF-8, whose structure chance seldom meets, or four and more characters read from the
    Korean code page as western text."""
    for name, back in inverses().items():
        if name.startswith("cp949") and (len(token) < LEAST_WESTERN or not name.startswith(("cp949>cp1252", "cp949>latin-1"))):
            continue
        if any(m in name for m in _MULTI) and len(token) < LEAST_PAIRED:
            continue
        try:
            word = back(token)
        except (UnicodeError, KeyError):
            continue
        if regex.fullmatch(r"\p{Han}{1,2}", word):
            continue  # a few letters and a space may read as an ideograph by chance
        if word != token and not word.isascii() and regex.fullmatch(r"[가-힣\p{Han}\p{Latin}\p{P}\p{S}]+", word) and not regex.search(r"[\x80-\x9f]", word):
            return word, name
    return None


def _undone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(t, *hit) for t in b["token"] if (hit := undo(t))]
        yield pd.DataFrame(rows, columns=["token", "word", "chain"])


_RUN_OF = re.compile(RUN)
_PLAIN = re.compile("[가-힣]+")


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, digest of the text, n_odd, runs of each text that has any."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if runs := sorted(set(_RUN_OF.findall(text))):
                row = (doc, hashlib.md5(text.encode(), usedforsecurity=False).digest(), sum(not _PLAIN.fullmatch(x) for x in runs), runs)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.string())), strict=True)], ["doc_id", "digest", "n_odd", "runs"])


def token_sets(documents: DataFrame) -> DataFrame:
    """doc_id, digest, n_odd, runs: the distinct runs outside ASCII of each document, and how many of them are
    not plain Hangul. Read from the texts once and staged, for the vocabulary and for the evidence."""
    return staged(spread(documents.select("doc_id", "text")).mapInArrow(_token_sets, "doc_id long, digest binary, n_odd int, runs array<string>"), "token-sets")


def vocabulary(sets: DataFrame) -> DataFrame:
    """token, n_docs over the whole corpus. Repeated texts count once."""
    texts = sets.select("digest", "runs").distinct()
    return texts.select(F.explode("runs").alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))


SALTS = 8  # parts that the rows of a token are cut into, for a garbled text may stand in a third of all rows


def _meeting(tokens: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, n_odd, runs, hashes = (b.column(i) for i in range(4))
            hit = np.flatnonzero(tokens.contains(hashes.flatten().to_numpy(zero_copy_only=False)))
            row = np.repeat(np.arange(b.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))[hit]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), n_odd.take(pa.array(row)), runs.flatten().take(pa.array(hit))], ["doc_id", "n_odd", "token"])

    return run


def doc_tokens(sets: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_odd, token: the runs of each document that may be among the tokens of ``found``."""
    names = found.select(F.xxhash64("token").alias("h")).distinct()
    rows = sets.select("doc_id", "n_odd", "runs", F.transform("runs", lambda x: F.xxhash64(x)).alias("h"))
    return rows.mapInArrow(_meeting(Bloom(names, names.count())), "doc_id long, n_odd int, token string")


def _beyond_chance() -> Column:
    """Whether no clean text explains a match of token and word, however often the token stands: it holds
    characters that only a wrong reading makes, or the original is long enough. Signs alone never are, for
    those of one code page are those of another."""
    word, token = F.col("word"), F.col("token")
    letters = F.length(F.regexp_replace(word, r"[^\p{L}]", ""))
    utf8 = F.col("chain").startswith("utf-8") & word.rlike(r"[가-힣\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{2}")
    mixed = (letters > 1) & (F.length(token) > 3) & token.rlike(r"\p{L}") & token.rlike(r"[^\p{L}\p{M}]")
    return F.col("clean") & (F.length(token) > 1) & (token.rlike(r"[\x{80}-\x{9F}\x{FFFD}]") | (letters > 2) | utf8 | mixed)


def matches(sets: DataFrame) -> DataFrame:
    """Garbled tokens of the corpus: token, word (the original), chain, sure, counted, strong.

    ``sure``: the corpus (``counted``) or the token verifies the match; else only other tokens of the
    document can. Of several originals, one that the corpus verifies goes first.
    ``strong``: the token alone shows that its document is garbled. A token of plain letters that real
    text may hold (few accented letters, one ideograph or syllable, Hangul with less than two rare syllables) is not."""
    vocab = staged(vocabulary(sets), "vocabulary")
    words = vocab.filter(~F.col("token").rlike(_BROKEN)).select(F.col("token").alias("word"), F.col("n_docs").alias("word_docs"))
    tokens = Bloom(vocab.select(F.xxhash64("token").alias("h")), vocab.count())
    table = spread(words).mapInPandas(_garbled_forms(tokens), "key string, word string, word_docs long, clean boolean, chain string")
    counted = F.expr("word_docs >= token_docs and (length(token) > 1 or word_docs > token_docs)")
    hits = table.join(vocab.select(key(F.col("token")).alias("key"), "token", F.col("n_docs").alias("token_docs")), "key").drop("key")
    long = words.filter(F.length("word") > LONGEST_KEY).select(key(F.col("word")).alias("word"), F.col("word").alias("whole"))
    hits = hits.join(long, "word", "left").withColumn("word", F.coalesce("whole", "word")).drop("whole").withColumn("counted", counted).withColumn("sure", F.col("counted") | _beyond_chance())
    hits = hits.filter(F.col("sure") | F.col("clean") & F.col("token").rlike(r"\p{L}"))
    best = hits.groupBy("token", "chain").agg(F.max_by("word", F.struct("counted", "sure", "word_docs", "word")).alias("word"), F.max("sure").alias("sure"), F.max("counted").alias("counted"))
    best = staged(best, "garbled-tokens")
    odd = vocab.filter(~F.col("token").rlike(_HANGUL) & (F.length("token") > 1)).select("token")
    # A plainer path beside the table, for words that stand nowhere clean: it adds to the table's tokens and replaces none.
    rest = spread(odd.join(best.filter("sure").select("token").distinct(), "token", "left_anti")).mapInPandas(_undone, "token string, word string, chain string")
    t = F.regexp_replace("token", r"[\p{Z}\p{Cf}]", "")  # spaces and soft hyphens strew clean text as well
    korean = F.col("word").rlike("[가-힣]")
    plain = F.col("token").rlike("^[가-힣]{2,}$")
    rare = F.length(F.regexp_replace("token", f"[{_COMMON}]", ""))
    strong = (
        (plain & (rare > 1))
        | ((F.length("word") > 11) & (F.length(t) > 11))  # no chance makes a match as long
        | (t.rlike(r"[^\p{L}\p{M}]") & (F.length("token") > 1))
        | (t.rlike(r"^\p{IsLatin}+$") & ((F.length(t) > 3) | (F.length("token") > 3) & F.col("word").rlike("[가-힣]{2}")))
        | (t.rlike(r"\p{IsHan}") & (F.length(t) > 1) & korean)
        | (~t.rlike(r"^\p{IsLatin}+$") & ~t.rlike(_HANGUL) & (F.length(t) > 2) & (korean | ~t.rlike(r"\p{IsHan}")))
    )
    yes = F.lit(True)
    both = best.select("token", "word", "chain", "sure", "counted").unionByName(rest.select("token", "word", "chain", yes.alias("sure"), yes.alias("counted")))
    # Hangul alone: syllables outside the standard set are evidence, others only what else the document shows
    both = both.withColumn("sure", F.col("sure") & (~plain | (rare > 0)))
    return both.withColumn("strong", F.col("sure") & strong)


def evidence(sets: DataFrame, found: DataFrame) -> DataFrame:
    """For each document with a garbled token: doc_id, chain (the one with most garbled characters),
    n_strong, n_weak (of one chain), n_odd, and fixes (token, word, chain) for its tokens. Tokens that
    aren't sure are no evidence; they are fixed if others show their chain."""
    found = staged(found, "garbled-words")
    tokens = doc_tokens(sets, found).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sure, strong = F.col("sure"), F.col("strong")
    by_chain = tokens.join(found, ["token", "salt"]).groupBy("doc_id", "chain").agg(
        F.first("n_odd").alias("n_odd"), F.count_if(strong).alias("strong"), F.count_if(sure & ~strong).alias("weak"),
        F.sum(F.when(sure, F.length("token")).otherwise(0)).alias("chars"), F.collect_list(F.struct("token", "word", "sure", "counted")).alias("fixes"),
    )
    read = lambda x: F.substring_index(x["chain"], ":", 1)  # whatever became of undefined bytes
    seen = lambda x: F.aggregate(F.filter("groups", lambda y: read(y) == read(x)), F.lit(0).cast("long"), lambda n, y: n + y["strong"] * 2 + y["weak"]) > 1
    kept = lambda x: F.when(seen(x), x["fixes"]).otherwise(F.filter(x["fixes"], lambda f: f["sure"]))
    by_doc = by_chain.groupBy("doc_id").agg(
        F.first("n_odd").alias("n_odd"), F.sum("strong").alias("n_strong"), F.max(F.col("strong") + F.col("weak")).alias("n_chain"),
        F.max_by("chain", F.struct("chars", "chain")).alias("chain"), F.collect_list(F.struct("chars", "chain", "strong", "weak", "fixes")).alias("groups"),
    )
    fixes = F.transform("groups", lambda x: F.struct(x["chars"].alias("chars"), x["chain"].alias("chain"), kept(x).alias("fixes")))
    return by_doc.filter("n_strong > 0 or n_chain > 0").select("doc_id", "n_odd", "n_strong", "n_chain", "chain", fixes.alias("fixes"))


def garbled(documents: DataFrame) -> DataFrame:
    """``evidence`` of the documents that are garbled: at least one strong token, or two tokens of one
    chain that are half of all odd ones. Null and empty texts and documents without an id are never."""
    rows = documents.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = token_sets(rows)
    return evidence(sets, matches(sets)).filter("n_strong > 0 or (n_chain > 1 and n_chain * 2 >= n_odd)")


def repair(text: str, chain: str, fixes: dict[str, str]) -> tuple[str, int, int]:
    """The text with its garbled runs replaced; how many were and how many odd ones were not."""
    back = inverses().get(chain)
    done = left = 0

    def put(m: regex.Match) -> str:
        nonlocal done, left
        run = m.group()
        word = fixes.get(run)
        if word is None and back is not None and not regex.fullmatch(_HANGUL, run):
            try:
                word = back(run)
            except (UnicodeError, KeyError):
                word = None
        if word is not None and word != run:
            done += 1
            return word
        left += bool(regex.search(r"[\x80-\x9f�]", run))
        return run

    return regex.sub(RUN, put, text), done, left


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text, chain, fixes in zip(b["doc_id"], b["text"], b["chain"], b["fixes"], strict=True):
            known: dict[str, str] = {}
            parts = sorted(fixes, key=lambda p: (p["chain"] == chain, p["chars"]))
            for counted in (False, True):
                for part in parts:
                    known.update({f["token"]: f["word"] for f in part["fixes"] if f["counted"] == counted})
            rows.append((doc, *repair(text, chain, known), chain))
        yield pd.DataFrame(rows, columns=["doc_id", "text", "n_repaired", "n_left", "chain"])


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, text (repaired where possible), n_repaired, n_left, chain of the garbled documents. Rows
    that share a doc_id are each repaired."""
    found = staged(garbled(documents).select("doc_id", "chain", "fixes"), "garbled")
    ids = found.select(F.xxhash64("doc_id").alias("h"))
    rows = documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Only texts that may be garbled move to their fixes.
    rows = rows.filter(Bloom(ids, ids.count()).might(F.xxhash64("doc_id"))).join(found, "doc_id")
    return rows.mapInPandas(_repaired, "doc_id long, text string, n_repaired int, n_left int, chain string")
