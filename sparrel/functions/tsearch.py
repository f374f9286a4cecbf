"""Full-text search: lexemes with positions, queries, matching and ranks.

A tsvector is array<struct<lexeme string, positions array<int>, weight string>>,
sorted by lexeme. Text is turned into it by a vectorised function; matching is a
Column expression wherever positions are not needed, and higher-order functions
for phrases, so that a query on a stored tsvector needs no Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

VECTOR = "array<struct<lexeme:string,positions:array<int>,weight:string>>"
#: English stop words: fixed values.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves"
    " what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while"
    " of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there"
    " when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|\d+(?:\.\d+)?")
LARGEST_POSITION = 16383
#: Bytes of text, and entries of tsvectors, that are Python objects at one time, about; a longer row stands alone.
SLICE_BYTES = 500_000
SLICE_ENTRIES = 20_000

# The English stemmer (Porter 2), after its published description.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with stems of their own, and words that stay as they are after the first step: fixed values.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (k == 0 or w[k - 1] in VOWELS) else c for k, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end in ("eed", "eedly"):
                w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
            elif any(c in VOWELS for c in w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif _ends_short(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, put in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + put
            break
    for end, put in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + put
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexize(word: str, config: str) -> str | None:
    """The lexeme of a word; None for a stop word."""
    low = word.lower()
    if config == "simple":
        return low
    return None if low in STOP else stem(low)


def lexemes_of(text: str, config: str) -> dict[str, list[int]]:
    """Each lexeme's positions."""
    found: dict[str, list[int]] = {}
    for k, word in enumerate(WORD.findall(text.lower()), 1):
        found.setdefault(word, []).append(k)
    if config != "simple":
        words, found = found, {}
        for word, places in words.items():
            if (lexeme := lexize(word, config)) is not None:
                found[lexeme] = sorted(found[lexeme] + places) if lexeme in found else places
    return found


def vectors(texts: pa.Array, config: str) -> pa.Array:
    """The tsvectors of an array of texts, built column by column. At most 256 positions of a lexeme are kept, up to 16383."""
    lexemes: list[str] = []
    flat: list[int] = []
    place_off, row_off, gone = [0], [0], []
    for text in texts.to_pylist():
        gone.append(text is None)
        found = lexemes_of(text or "", config)
        for word in sorted(found):  # code point order is the order of UTF-8 bytes
            lexemes.append(word)
            flat += found[word][:256]
            place_off.append(len(flat))
        row_off.append(len(lexemes))
    places = pc.min_element_wise(pa.array(flat, pa.int32()), pa.scalar(LARGEST_POSITION, pa.int32()))
    cells = [pa.array(lexemes, pa.string()), pa.ListArray.from_arrays(pa.array(place_off, pa.int32()), places), pa.repeat(pa.scalar("D"), len(lexemes))]
    entries = pa.StructArray.from_arrays(cells, ["lexeme", "positions", "weight"])
    return pa.ListArray.from_arrays(pa.array(row_off, pa.int32()), entries, mask=pa.array(gone, pa.bool_()))


def _slices(values: pa.Array, sizes: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Cut an array into runs whose sizes add up to ``limit`` or less; a larger value stands alone, with those of no size."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield values.slice(at, to - at)
        at = to


def sliced_vectors(batches: Iterator[pa.Array], config: str) -> Iterator[pa.Array]:
    """The tsvectors of batches of texts, a slice at a time, so that a worker's memory does not grow with the batch."""
    for texts in batches:
        if not len(texts):
            yield vectors(texts, config)
        for part in _slices(texts, pc.binary_length(texts), SLICE_BYTES):
            yield vectors(part, config)


def to_tsvector(text: Column, config: str = "english") -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced_vectors(batches, config)

    return arrow_udf(run, VECTOR)(text)


def strip(v: Column) -> Column:
    return F.transform(v, lambda x: F.struct(x["lexeme"].alias("lexeme"), F.array().cast("array<int>").alias("positions"), F.lit("D").alias("weight")))


def setweight(v: Column, weight: str) -> Column:
    return F.transform(v, lambda x: F.struct(x["lexeme"].alias("lexeme"), x["positions"].alias("positions"), F.lit(weight).alias("weight")))


def delete(v: Column, *lexemes: str) -> Column:
    return F.filter(v, lambda x: ~x["lexeme"].isin(*lexemes))


def filter_weights(v: Column, *weights: str) -> Column:
    return F.filter(v, lambda x: x["weight"].isin(*weights))


def to_text(v: Column) -> Column:
    one = lambda x: F.concat(F.lit("'"), x["lexeme"], F.lit("'"), F.when(F.size(x["positions"]) > 0, F.concat(F.lit(":"), F.array_join(F.transform(x["positions"], lambda p: F.concat(p.cast("string"), F.when(x["weight"] == "D", F.lit("")).otherwise(x["weight"]))), ","))).otherwise(F.lit("")))
    return F.array_join(F.transform(v, one), " ")


# Queries: ("&", a, b), ("|", a, b), ("!", a), ("<->", a, b, distance), ("w", lexeme, prefix, weights), or None.
QUERY = re.compile(r"\s*(?:(<->|<\d+>|[&|!()])|('(?:[^']|'')*'|[^\s&|!()<>:*]+)(?::([*A-Da-d]+))?)")


def parse_query(text: str, config: str | None = "english"):
    """to_tsquery: operators & | ! <-> <n>, parentheses, prefixes :* and weights :A. Stop words drop out."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = QUERY.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"syntax error in tsquery: {text!r}")
        tokens.append(m.groups())
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos][0] if pos < len(tokens) else None

    def level(ops, below):
        nonlocal pos
        left = below()
        while (op := peek()) and (op in ops or ("<" in ops and op.startswith("<"))):
            pos += 1
            left = join(op, left, below())
        return left

    def atom():
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"syntax error in tsquery: {text!r}")
        op, word, flags = tokens[pos]
        pos += 1
        if op == "!":
            inner = atom()
            return None if inner is None else ("!", inner)
        if op == "(":
            inner = level("|", lambda: level("&", lambda: level("<", atom)))
            if peek() != ")":
                raise ValueError(f"syntax error in tsquery: {text!r}")
            pos += 1
            return inner
        if op:
            raise ValueError(f"syntax error in tsquery: {text!r}")
        flags = (flags or "").upper()
        words = [word.strip("'").replace("''", "'")] if config is None else [m[0] for m in WORD.finditer(word.strip("'"))]
        out = None
        for w in words:
            lexeme = w if config is None else lexize(w, config)
            if lexeme is not None:
                out = join("<->", out, ("w", lexeme, "*" in flags, "".join(c for c in flags if c != "*")))
        return out

    got = level("|", lambda: level("&", lambda: level("<", atom)))
    if pos != len(tokens):
        raise ValueError(f"syntax error in tsquery: {text!r}")
    return got


def join(op: str, a, b):
    """Two queries with an operator; one that has dropped out leaves the other."""
    if a is None or b is None:
        return b if a is None else a
    if op.startswith("<"):
        return ("<->", a, b, 1 if op == "<->" else int(op[1:-1]))
    return (op, a, b)


def plain_query(text: str, config: str = "english"):
    out = None
    for m in WORD.finditer(text):
        lexeme = lexize(m[0], config)
        out = join("&", out, None if lexeme is None else ("w", lexeme, False, ""))
    return out


def phrase_query(text: str, config: str = "english"):
    out, gap = None, 1
    for m in WORD.finditer(text):
        lexeme = lexize(m[0], config)
        if lexeme is None:
            gap += out is not None
            continue
        out = ("w", lexeme, False, "") if out is None else ("<->", out, ("w", lexeme, False, ""), gap)
        gap = 1
    return out


def web_query(text: str, config: str = "english"):
    """Words, "phrases", or, and - for not."""
    out, op = None, "&"
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', text):
        minus, word = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if m[2] is None and word.lower() == "or" and not minus:
            op = "|"
            continue
        got = phrase_query(word, config)
        if got is not None and minus:
            got = ("!", got)
        if op == "|" and isinstance(out, tuple) and out[0] == "&":
            out = ("&", out[1], join("|", out[2], got))
        else:
            out = join(op, out, got)
        op = "&"
    return out


def _entries(v: Column, q) -> Column:
    hit = lambda x: (F.startswith(x["lexeme"], F.lit(q[1])) if q[2] else x["lexeme"] == q[1]) & (x["weight"].isin(*q[3]) if q[3] else F.lit(True))
    return F.filter(v, hit)


def _places(v: Column, q) -> Column:
    """Positions at which a phrase's operand ends."""
    if q[0] == "w":
        return F.array_distinct(F.flatten(F.transform(_entries(v, q), lambda x: x["positions"])))
    if q[0] == "|":
        return F.array_union(_places(v, q[1]), _places(v, q[2]))
    if q[0] == "&":
        return F.array_intersect(_places(v, q[1]), _places(v, q[2]))
    if q[0] == "<->":
        return F.array_intersect(F.transform(_places(v, q[1]), lambda p: p + q[3]), _places(v, q[2]))
    raise ValueError("negation inside a phrase is not supported")


def matches(v: Column, query) -> Column:
    """v @@ query; an empty query matches nothing."""
    if query is None:
        return F.when(v.isNotNull(), F.lit(False))
    if query[0] == "w":
        return F.size(_entries(v, query)) > 0
    if query[0] == "!":
        return ~matches(v, query[1])
    if query[0] == "&":
        return matches(v, query[1]) & matches(v, query[2])
    if query[0] == "|":
        return matches(v, query[1]) | matches(v, query[2])
    return F.size(_places(v, query)) > 0


#: The words of a text, as WORD finds them.
JAVA_WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"


def text_matches(text: Column, query) -> Column:
    """to_tsvector('simple', text) @@ query without a tsvector: a built-in expression over the text's words.

    Weights are not known here. Places have no upper bound, as they have in a stored tsvector.
    """
    if query is None:
        return F.when(text.isNotNull(), F.lit(False))
    return _in_words(F.regexp_extract_all(F.lower(text), F.lit(JAVA_WORD), F.lit(0)), query)


def _in_words(words: Column, q) -> Column:
    if q[0] == "w":
        return F.exists(words, lambda w: F.startswith(w, F.lit(q[1]))) if q[2] else F.array_contains(words, q[1])
    if q[0] == "!":
        return ~_in_words(words, q[1])
    if q[0] in ("&", "|"):
        a, b = _in_words(words, q[1]), _in_words(words, q[2])
        return a & b if q[0] == "&" else a | b
    chain = _chain(q)
    if chain is not None:
        return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(chain)} "))
    return F.size(_word_places(words, q)) > 0


def _chain(q) -> list[str] | None:
    """The words of a phrase of neighbours; None for other phrases."""
    if q[0] == "w":
        return None if q[2] else [q[1]]
    if q[0] != "<->" or q[3] != 1 or q[2][0] != "w":
        return None
    first, last = _chain(q[1]), _chain(q[2])
    return first + last if first and last else None


def _word_places(words: Column, q) -> Column:
    if q[0] == "w":
        hit = lambda w: F.startswith(w, F.lit(q[1])) if q[2] else w == q[1]
        return F.array_compact(F.transform(words, lambda w, k: F.when(hit(w), k)))
    if q[0] == "|":
        return F.array_union(_word_places(words, q[1]), _word_places(words, q[2]))
    if q[0] == "&":
        return F.array_intersect(_word_places(words, q[1]), _word_places(words, q[2]))
    if q[0] == "<->":
        return F.array_intersect(F.transform(_word_places(words, q[1]), lambda p: p + q[3]), _word_places(words, q[2]))
    raise ValueError("negation inside a phrase is not supported")


def _operands(q) -> list:
    return [] if q is None else [q] if q[0] == "w" else [w for part in q[1:] if isinstance(part, tuple) for w in _operands(part)]


WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def _word_distance(w: int) -> float:
    return 1e-30 if w > 100 else 1.0 / (1.005 + 0.05 * math.exp(w / 1.5 - 2))


def rank_value(vector: list, query) -> float:
    """ts_rank with its default weights and normalisation 0."""
    words = list({(w[1], w[2]): w for w in _operands(query)}.values())
    held = []
    for w in words:
        for e in vector:
            if e["lexeme"].startswith(w[1]) if w[2] else e["lexeme"] == w[1]:
                held.append((list(e["positions"]) or [LARGEST_POSITION], WEIGHTS[e["weight"]]))
    if not held:
        return 0.0
    if query[0] in ("&", "<->") and len(words) > 1:
        out = -1.0
        for i in range(len(held)):
            for k in range(i):
                for a in held[i][0]:
                    for b in held[k][0]:
                        distance = abs(a - b)
                        if distance:
                            w = math.sqrt(held[i][1] * held[k][1] * _word_distance(distance))
                            out = w if out < 0 else 1 - (1 - out) * (1 - w)
        return max(out, 0.0)
    total = 0.0
    for places, weight in held:
        sums, best, best_at = 0.0, -1.0, 0
        for k in range(len(places)):
            sums += weight / ((k + 1) ** 2)
            if weight > best:
                best, best_at = weight, k
        total += (best + sums - best / ((best_at + 1) ** 2)) / 1.64493406685
    return total / len(words)


def _scores(v: Column, query, score: Callable) -> Column:
    """score(vector, query) of each vector, in Python. Only the entries of the query's words go there, a slice at a time."""
    named = lambda x: [F.startswith(x["lexeme"], F.lit(w[1])) if w[2] else x["lexeme"] == w[1] for w in _operands(query)]
    needed = F.filter(v, lambda x: reduce(Column.__or__, named(x), F.lit(False)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            if not len(rows):
                yield pa.array([], pa.float64())
            for part in _slices(rows, pc.add(pc.list_value_length(rows), 1), SLICE_ENTRIES):
                yield pa.array([None if x is None else score(x, query) for x in part.to_pylist()], pa.float64())

    return arrow_udf(run, "double")(needed)


def ts_rank(v: Column, query) -> Column:
    return _scores(v, query, rank_value)


def _ends(q, held: dict) -> set[int]:
    """Places at which a phrase's operand ends, of the places that are held for each word."""
    if q[0] == "w":
        return held.get((q[1], q[2]), set())
    if q[0] == "|":
        return _ends(q[1], held) | _ends(q[2], held)
    if q[0] == "<->":
        return {p + q[3] for p in _ends(q[1], held)} & _ends(q[2], held)
    return _ends(q[1], held) & _ends(q[2], held)


def _satisfied(q, held: dict) -> bool:
    if q[0] == "!":
        return not _satisfied(q[1], held)
    if q[0] == "|":
        return _satisfied(q[1], held) or _satisfied(q[2], held)
    if q[0] == "&":
        return _satisfied(q[1], held) and _satisfied(q[2], held)
    return bool(_ends(q, held))


def cover_density(vector: list, query) -> float:
    """ts_rank_cd with its default weights and normalisation 0: the shortest extents of the text that satisfy the query.

    An extent counts the harmonic mean of its entries' weights, divided by one more
    than the words between them.
    """
    words = list({(w[1], w[2]) for w in _operands(query)})
    at: dict[int, tuple[list, float]] = {}
    for e in vector:
        names = [w for w in words if (e["lexeme"].startswith(w[0]) if w[1] else e["lexeme"] == w[0])]
        for p in e["positions"] if names else ():
            before, weight = at.get(p, ([], 0.0))
            at[p] = before + names, max(weight, WEIGHTS[e["weight"]])
    places = sorted(at)

    def grow(order) -> int | None:
        """The first index of ``order`` with which the query is satisfied."""
        held: dict = {}
        for k in order:
            for w in at[places[k]][0]:
                held.setdefault(w, set()).add(places[k])
            if _satisfied(query, held):
                return k
        return None

    total, begin = 0.0, 0
    while (end := grow(range(begin, len(places)))) is not None:
        first = grow(range(end, begin - 1, -1))
        first = begin if first is None else first
        inverse = sum(1 / at[p][1] for p in places[first : end + 1])
        n = end - first
        noise = places[end] - places[first] - n
        total += (n + 1) / inverse / (1 + (noise if noise >= 0 else n / 2))
        begin = first + 1
    return total


def ts_rank_cd(v: Column, query) -> Column:
    return _scores(v, query, cover_density)
