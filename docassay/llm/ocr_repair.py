"""Repair of text from scanned pages: furniture removal, joined lines and corrected characters.

Three averaged perceptrons are trained here, on all pages. The character editor predicts one operation for
each character (keep, replace, delete, insert); it learns from every form of a word in the clean text of
the corpus, corrupted by the confusions that the scanned pages themselves show: where an unknown word of
a scan differs in one place from a known one, that place counts. The joins of broken lines learn from
every place where a clean word can break, and from every compound. The furniture model reads position
features of each line; it learns from the lines that the header, footer and page-number fields of the
pages name, also with those features hidden.

What the models learn from is counted first: equal words, joins and lines of all pages are one row with
their number. Rows that are too many for one task are shared out by a hash; the weights of the shares are
averaged (parameter mixing).

The vocabulary is counted over all text-layer pages. Its most frequent words, a bounded set, go to the
workers; every other word is looked up by an exact join, once for each distinct word, so a word's state
and its correction are the same on all pages and don't depend on the size of the corpus. The editor runs
on distinct unknown words only; a word is edited where the operations, scored against keeping every
character, exceed a margin that is calibrated on all clean words and lead to a known word.

Defined results: null and empty pages give no row; a word without a known correction stays as it is;
scripts without spaces keep their characters (their words are no units here); a redelivered page counts
once.
"""

from __future__ import annotations

import heapq
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

# Letters that character recognition reads for a digit; any number is a word, so these can't be learnt from words.
DIGIT_READ = {"0": "Oo", "1": "lI", "2": "Z", "5": "S", "6": "b", "8": "B", "9": "g"}
#: Marks that may stand at the end of a broken line.
BREAK_MARKS = "-¬­‐‑⁃"
#: Frequent words that are sent to the workers (others are joined), and bits of the filter that spares most joins of a candidate.
COMMON_WORDS, FILTER_BITS = 50_000, 1 << 23
#: Examples of the editor when it is trained on a list of pages at hand (a seeded choice from all of them); ``prepared`` has no such bound.
TRAIN_EXAMPLES = 400_000
#: Rows, by their repeats, that one task trains on; more are shared out.
SHARE_ROWS = 60_000
#: Repeats of the joins, in proportion to their numbers, beside one for each kind of join.
JOIN_REPEATS = 20_000
#: Distinct misread words that a confusion is learnt from.
LEAST_FORMS = 3
#: Hypotheses kept while a word is edited in more than two neighbouring places.
BEAM = 32

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SPACELESS = re.compile("[฀-๿　-ヿ㐀-鿿豈-﫿]")
_TAIL = re.compile(rf"([^\W_]+(?:['’][^\W_]+)*)([{re.escape(BREAK_MARKS)}])\s*$")
_HEAD = re.compile(r"\s*([^\W_]+(?:['’][^\W_]+)*)")


# ---- vocabulary -------------------------------------------------------------------------------


def key_of(word: str) -> str:
    """Words in lower case; in a mix of letters and digits any digit counts as 0."""
    word = word.lower()
    return word if word.isalpha() else re.sub(r"[0-9]", "0", word)


def form_of(word: str) -> str:
    """A word as the editor reads it: in lower case, unless half of it or more are digits."""
    if word.isalpha():
        return word.lower()
    digits = sum(c.isdigit() for c in word)
    return word if digits and digits * 2 >= len(word) else word.lower()


def vocabulary(pdf_pages: DataFrame) -> DataFrame:
    """(word, n): words of at least two text-layer pages with their places, in the form of ``key_of``."""
    return _vocabulary(clean_tokens(pdf_pages))


def _vocabulary(tokens: DataFrame) -> DataFrame:
    keys = tokens.where("NOT w RLIKE '^[0-9]+$'").groupBy(_key("w").alias("word")).agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    # two pages, not two rows: a redelivered page doesn't make its words known
    return keys.where("a <> b").select("word", "n")


class Common:
    """The frequent words; all digits count as a word."""

    def __init__(self, words: set[str]):
        self.words = words

    def __contains__(self, word: str) -> bool:
        return word.isdigit() or key_of(word) in self.words


# ---- averaged perceptron ----------------------------------------------------------------------


class Perceptron:
    """Averaged multiclass perceptron over string features; row 0 of the weights belongs to features never seen."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.classes: list[str] = []
        self.seen_with: dict[str, list[int]] = {}
        self.leads: dict[tuple[str, str], dict[str, float]] = {}
        self.w = np.zeros((1, 1), np.float32)

    def rows(self, features: list[str]) -> list[int]:
        get = self.ids.get
        return [get(f, 0) for f in features]

    def scores(self, features: list[list[str]]) -> np.ndarray:
        """Score of each class for each list of features (lists of one length)."""
        return self.w[np.array([self.rows(f) for f in features], np.int32)].sum(axis=1)

    def lead(self, features: list[str], a: str, b: str) -> float:
        """How far class a is before class b."""
        if (a, b) not in self.leads:
            column = {c: self.w[:, i] for i, c in enumerate(self.classes)}
            none = np.zeros(len(self.w), np.float32)
            difference = (column.get(a, none) - column.get(b, none)).tolist()
            self.leads[a, b] = {f: difference[i] for f, i in self.ids.items()}
        get = self.leads[a, b].get
        return sum([get(f, 0.0) for f in features])

    def train(self, data: Iterable[tuple[list[str], str]], epochs: int, seed: int = 7) -> Perceptron:
        ids: dict[str, int] = {}
        examples, labels = [], []
        for x, y in data:
            examples.append(np.array([ids.setdefault(f, len(ids) + 1) for f in x], np.int32))
            labels.append(y)
        self.classes = sorted(set(labels))
        number = {c: i for i, c in enumerate(self.classes)}
        wanted = [number[y] for y in labels]
        w = np.zeros((len(ids) + 1, len(self.classes)), np.float32)
        late = np.zeros_like(w)
        step, order = 1, list(range(len(examples)))
        shuffle = random.Random(seed).shuffle
        for _ in range(epochs):
            shuffle(order)
            for i in order:
                x, y = examples[i], wanted[i]
                guess = int(w[x].sum(axis=0).argmax())
                if guess != y:
                    w[x, y] += 1.0
                    w[x, guess] -= 1.0
                    late[x, y] += step
                    late[x, guess] -= step
                step += 1
        w -= late / step
        # features that ended without a weight are as good as unseen
        kept = np.nonzero(np.abs(w).max(axis=1) > 1e-3)[0]
        place = {int(k): j + 1 for j, k in enumerate(kept)}
        self.ids = {f: place[i] for f, i in ids.items() if i in place}
        self.w = np.vstack([np.zeros((1, w.shape[1]), np.float32), w[kept]])
        return self


def fitted(rows: DataFrame, examples: Callable[[list[tuple]], Iterable[tuple[list[str], str]]], epochs: int, seed: int) -> Perceptron:
    """A perceptron on all rows; times, the last column, is how often a row is repeated.

    The first column says which share a row goes to, so the model doesn't depend on how the rows lie.
    """
    names = rows.columns
    total = rows.agg(F.sum("times")).first()[0]
    model = Perceptron()
    if not total:
        return model
    shares = -(-int(total) // SHARE_ROWS)

    def train(table: pa.Table) -> pa.Table:
        own, size, seen = Perceptron(), 0, set()

        def counted() -> Iterator[tuple[list[str], str]]:
            nonlocal size
            for x, y in examples(sorted(zip(*(table.column(c).to_pylist() for c in names), strict=True))):
                size += 1
                seen.add((x[1][1:] if x[0] == "b" and x[1][0] == "c" else "", y))
                yield x, y

        own.train(counted(), epochs, seed)
        out = [("size", "", "", size), *(("seen", a, y, 1) for a, y in sorted(seen))]
        for f, i in own.ids.items():
            # whole numbers, so that sums don't depend on their order
            out += [("weight", f, own.classes[k], int(round(float(own.w[i, k]) * 65536)) * size) for k in np.nonzero(own.w[i])[0]]
        return pa.table({"kind": pa.array([r[0] for r in out], pa.string()), "a": pa.array([r[1] for r in out], pa.string()), "b": pa.array([r[2] for r in out], pa.string()), "x": pa.array([r[3] for r in out], pa.int64())})

    found = rows.withColumn("share", F.pmod(F.xxhash64(names[0]), F.lit(shares))).groupBy("share").applyInArrow(train, "kind string, a string, b string, x bigint").groupBy("kind", "a", "b").agg(F.sum("x").alias("x")).collect()
    size = sum(r.x for r in found if r.kind == "size")
    model.classes = sorted({r.b for r in found if r.kind == "seen"})
    number = {c: i for i, c in enumerate(model.classes)}
    weights = [(r.a, number[r.b], r.x / 65536 / max(1, size)) for r in found if r.kind == "weight"]
    model.ids = {f: i + 1 for i, f in enumerate(sorted({f for f, *_ in weights}))}
    model.w = np.zeros((len(model.ids) + 1, max(1, len(model.classes))), np.float32)
    for f, k, x in weights:
        model.w[model.ids[f], k] = x
    # the operations that occur at a character: others have no score there that means anything
    for a, y in sorted((r.a, r.b) for r in found if r.kind == "seen" and r.a and r.b != "K"):
        model.seen_with.setdefault(a, []).append(number[y])
    return model


# ---- confusions -------------------------------------------------------------------------------


def _gaps(word: str) -> Iterator[tuple[str, str, str]]:
    """(before, taken out, behind) with none, one or two neighbouring characters taken out."""
    for i in range(len(word) + 1):
        for j in range(i, min(len(word), i + 2) + 1):
            yield word[:i], word[i:j], word[j:]


def whole_unknown(texts: list[str], known: Common) -> Counter:
    """Unknown forms of texts with their number, without the halves of broken words."""
    out: Counter = Counter()
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip()]
        halves = [pair for a, b in zip(lines, lines[1:], strict=False) if (pair := _broken(a, b))]
        out.update(form_of(w) for w in _TOKEN.findall(text) if len(w) > 2 and w not in known and not _SPACELESS.search(w))
        out.subtract(form_of(m[1]) for pair in halves for m in pair if len(m[1]) > 2 and m[1] not in known)
    return +out


def learnt_confusions(unknown: Counter, words: set[str]) -> list[tuple[str, str, float]]:
    """(true, read, weight): what stands in scans in place of what, from unknown words that differ in one place from a known one.

    Each distinct word counts once, however often one stands in running lines; of several readings those
    that change least count, in equal parts. Readings of fewer than LEAST_FORMS words are coincidences.
    """
    places: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for form in unknown:
        if len(form) < 4:
            continue
        for before, read, behind in _gaps(form):
            if len(before) + len(behind) > 2:
                places[before, behind].append((form, read))
    found: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for word in words:
        for before, true, behind in _gaps(word):
            for form, read in places.get((before, behind), ()):
                # one place: nothing in common at its ends, and something changes
                if true != read and not (true and read and (true[0] == read[0] or true[-1] == read[-1])):
                    found[form].add((true, read))
    times: Counter = Counter()
    for form, readings in found.items():
        least = min(len(t) + len(r) for t, r in readings)
        best = [x for x in readings if len(x[0]) + len(x[1]) == least]
        for x in best:
            times[x] += 1 / len(best)
    return [(true, read, n**0.5) for (true, read), n in sorted(times.items()) if n >= LEAST_FORMS]


def confusions_of(forms: DataFrame, words: DataFrame) -> list[tuple[str, str, float]]:
    """``learnt_confusions`` of all forms and words, by a join on what stays when a place is taken out."""

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                rows = [
                    (xxhash.xxh64_intdigest(f"{before}\n{behind}".encode("utf-8", "surrogatepass")) - (1 << 63), own, out, len(before))
                    for own in batch.column(0).slice(start, 2000).to_pylist() for before, out, behind in _gaps(own) if len(before) + len(behind) > 2
                ]
                yield _columns(rows, ["key", "own", "out", "at"], pa.int64(), pa.string(), pa.string(), pa.int32())

    schema = "key bigint, own string, out string, at int"
    a = forms.select("form").mapInArrow(gaps, schema).selectExpr("key", "own AS form", "out AS read", "at")
    b = words.select("word").mapInArrow(gaps, schema).selectExpr("key", "own AS word", "out AS meant", "at")
    pairs = a.join(b, ["key", "at"]).where("left(form, at) = left(word, at) AND substr(form, at + 1 + length(read)) = substr(word, at + 1 + length(meant))")
    # one place: nothing in common at its ends, and something changes
    pairs = pairs.where("meant <> read AND NOT (meant <> '' AND read <> '' AND (left(meant, 1) = left(read, 1) OR right(meant, 1) = right(read, 1)))")
    pairs = pairs.select("form", "meant", "read").distinct().withColumn("size", F.expr("length(meant) + length(read)"))
    by_form = Window.partitionBy("form")
    best = pairs.withColumn("least", F.min("size").over(by_form)).where("size = least").withColumn("parts", F.count("*").over(by_form))
    times = best.groupBy("meant", "read").agg(F.round(F.sum(1 / F.col("parts")), 6).alias("n")).where(F.col("n") >= LEAST_FORMS).collect()
    return sorted((r.meant, r.read, r.n**0.5) for r in times)


def operations(read: str, true: str) -> list[str]:
    """One operation for each character read (K keep, D delete, R replace, I insert behind) that gives what is true."""
    if not read:
        return []
    if len(read) == len(true):
        return [f"R{t}" for t in true]
    if len(read) > len(true):
        return [f"R{t}" for t in true] + ["D"] * (len(read) - len(true))
    return [f"R{t}" for t in true[: len(read) - 1]] + [f"R{true[len(read) - 1]}I{true[len(read) :]}"]


def applied(op: str, c: str) -> str:
    """What a character becomes."""
    if op == "K":
        return c
    if op == "D":
        return ""
    replaced, _, inserted = op[1:].partition("I") if op[0] == "R" and len(op) > 2 else (op[1:], "", "") if op[0] == "R" else (c, "", op[1:])
    return replaced + inserted


class Confusions:
    """Misread forms of words, as often as the scans show them."""

    def __init__(self, learnt: list[tuple[str, str, float]]):
        self.by_true: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for true, read, n in learnt:
            if true:
                self.by_true[true].append((read, n))
        self.added = [(read, n) for true, read, n in learnt if not true]

    def corrupt(self, word: str, rng: random.Random) -> tuple[str, list[str]] | None:
        """A misread form of a word and the operation at each of its characters that restores it."""
        if any(c.isdigit() for c in word):
            spots = [(i, word[i], read, 1) for i in range(len(word)) for read in DIGIT_READ.get(word[i], "")]
        else:
            spots = [(i, word[i : i + k], read, n) for i in range(len(word)) for k in (1, 2) for read, n in self.by_true.get(word[i : i + k], ()) if i + k <= len(word)]
            spots += [(i, "", read, n) for i in range(1, len(word)) for read, n in self.added]
        if not spots:
            return None
        i, true, read, _ = rng.choices(spots, [n for *_, n in spots])[0]
        if not read and not i:  # a lost first character has nothing to stand behind
            return None
        ops = ["K"] * i + operations(read, true) + ["K"] * (len(word) - i - len(true))
        if not read:
            ops[i - 1] = f"I{true}"
        made = word[:i] + read + word[i + len(true) :]
        return (made, ops) if made else None


# ---- character editor -------------------------------------------------------------------------


def char_features(word: str, i: int) -> list[str]:
    c, p, n = word[i], word[i - 1] if i else "^", word[i + 1] if i + 1 < len(word) else "$"
    pp, nn = word[i - 2] if i > 1 else "^", word[i + 2] if i + 2 < len(word) else "$"
    kind = lambda x: "9" if x.isdigit() else "a" if x.isalpha() else x
    digits = sum(x.isdigit() for x in word)
    mix = "d" if digits * 2 >= len(word) else "m" if digits else "a"
    return ["b", f"c{c}", f"cn{c}{n}", f"pc{p}{c}", f"pcn{p}{c}{n}", f"cnn{c}{n}{nn}", f"ppc{pp}{p}{c}", f"k{c}{mix}", f"kk{kind(p)}{c}{kind(n)}", f"km{c}{n}{mix}"]


def join_features(left: str, mark: str, right: str, state: str) -> list[str]:
    """Of a broken line; state: whether the whole word, its left and its right part are known, as y or n."""
    small = [f"Js{min(len(left), 4)}{min(len(right), 4)}", f"Ju{left.isupper()}"]
    return ["J", f"J{state}", f"Jm{mark}", f"Jm{mark}{state}", f"Jl{right[:1].islower()}{state}", f"Jd{right[:1].isdigit()}", *small, f"Jst{state}{left.isupper()}", f"Jk{state[:1]}"]


def _state(*known: bool) -> str:
    return "".join("y" if k else "n" for k in known)


def editor_examples(pages: list[str], known: Common, confusions: Confusions, seed: int) -> list[tuple[list[str], str]]:
    rng, data = random.Random(seed), []
    join = lambda left, mark, right, op: data.append((join_features(left, mark, right, _state(left + right in known, left in known, right in known)), op))
    for text in pages:
        for m in _TOKEN.finditer(text):
            word = m[0]
            if _SPACELESS.search(word) or len(word) < 2 or rng.random() > 0.25:
                continue
            form = form_of(word)
            if rng.random() < 0.7 and (made := confusions.corrupt(form, rng)):
                data += [(char_features(made[0], i), op) for i, op in enumerate(made[1])]
            elif rng.random() < 0.5:
                data += [(char_features(form, i), "K") for i in range(len(form))]
            if word.isalpha() and len(word) > 5 and rng.random() < 0.5:
                k = rng.randrange(2, len(word) - 2)
                join(word[:k], rng.choice(BREAK_MARKS), word[k:], "J")
        for m in re.finditer(r"([^\W_]+)-([^\W_]+)", text):  # the mark of a compound or tag stays
            join(m[1], "-", m[2], "K")
            join(m[1], rng.choice(BREAK_MARKS), m[2], "K")
    if len(data) > TRAIN_EXAMPLES:
        data = [data[i] for i in sorted(rng.sample(range(len(data)), TRAIN_EXAMPLES))]
    return data


def train_editor(pages: list[str], known: Common, confusions: Confusions, seed: int = 11) -> Perceptron:
    """The editor, from clean pages that are corrupted and broken here."""
    data = editor_examples(pages, known, confusions, seed)
    model = Perceptron()
    if data:
        model.train(data, 3)
        # the operations that occur at a character: others have no score there that means anything
        pairs = {(x[1][1:], y) for x, y in data if x[0] == "b" and y != "K"}
        for c, op in sorted(pairs):
            model.seen_with.setdefault(c, []).append(model.classes.index(op))
    return model


class Editor:
    """Applies the character operations to words that are not known."""

    def __init__(self, model: Perceptron, longest: int, margin: float = float("-inf")):
        self.model, self.longest, self.margin = model, longest, margin

    def candidates(self, form: str) -> Iterator[tuple[float, str, list[int]]]:
        """(gain over keeping all, text, positions read wrongly), the best first: one or two neighbouring places, then more.

        Four operations take four characters at most from a word, so one that is longer than the longest
        known word by more can't become a known word.
        """
        if len(form) < 2 or len(form) - 4 > self.longest or "K" not in self.model.classes or _SPACELESS.search(form):
            return
        scores = self.model.scores([char_features(form, i) for i in range(len(form))])
        keep = self.model.classes.index("K")
        choices = []
        for c, row in zip(form, scores.tolist(), strict=True):
            ops = sorted(((row[k] - row[keep], k) for k in self.model.seen_with.get(c, ())), reverse=True)
            choices.append([(gain, applied(self.model.classes[k], c)) for gain, k in ops])
        tried = [(-g, i, 1, t) for i, ops in enumerate(choices) for g, t in ops]
        tried += [(-g - h, i, 2, t + u) for i in range(len(form) - 1) for g, t in choices[i][:5] for h, u in choices[i + 1][:5]]
        heapq.heapify(tried)
        while tried:
            loss, i, n, text = heapq.heappop(tried)
            if -loss < self.margin:
                break
            out = form[:i] + text + form[i + n :]
            if len(out) > 1 and out != form:
                yield -loss, out, list(range(i, i + n))
        beam: list[tuple[float, str, tuple[int, ...]]] = [(0.0, "", ())]
        for i, c in enumerate(form):
            grown = [(s, out + c, at) for s, out, at in beam]
            grown += [(s + g, out + t, (*at, i)) for g, t in choices[i][:4] for s, out, at in beam if len(at) < 4]
            grown.sort(key=lambda x: (-x[0], len(x[2])))
            beam = grown[:BEAM]
        for gain, out, at in beam:
            if at and out != form and len(out) > 1 and gain >= self.margin:
                yield gain, out, list(at)

    def first(self, form: str, known) -> tuple[float, str, list[int]] | None:
        return next((x for x in self.candidates(form) if x[1] in known), None)


def word_examples(rows: list[tuple], confusions: Confusions, seed: int) -> Iterator[tuple[list[str], str]]:
    """Of (form, times): each form misread or kept."""
    for form, times in rows:
        rng = random.Random(f"{seed} {form}")
        for _ in range(times):
            if rng.random() < 0.7 and (made := confusions.corrupt(form, rng)):
                yield from ((char_features(made[0], i), op) for i, op in enumerate(made[1]))
            elif rng.random() < 0.5:
                yield from ((char_features(form, i), "K") for i in range(len(form)))


def _key(column: str):
    """``key_of`` in SQL."""
    return F.when(F.col(column).rlike("[0-9]"), F.regexp_replace(F.lower(column), "[0-9]", "0")).otherwise(F.lower(column))


def clean_tokens(pdf_pages: DataFrame) -> DataFrame:
    """(w, n, a, b): each word of the text-layer pages as written, how often, and the first and last page with it."""
    clean = pdf_pages.where("text_source = 'TEXT_LAYER' AND raw_text IS NOT NULL")
    words = clean.select("page_id", F.explode(F.regexp_extract_all("raw_text", F.lit(r"([\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*)"), 1)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"), F.min("page_id").alias("a"), F.max("page_id").alias("b"))


def clean_forms(tokens: DataFrame) -> DataFrame:
    """(form, form_key, n) of all words with at least two characters in scripts with spaces."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(form := form_of(w), key_of(form), n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in _TOKEN.findall(t) if len(w) > 1 and not _SPACELESS.search(w)]
            yield _columns(rows, ["form", "form_key", "n"], pa.string(), pa.string(), pa.int64())

    return tokens.select("w", "n").mapInArrow(forms, "form string, form_key string, n bigint").groupBy("form", "form_key").agg(F.sum("n").alias("n"))


def fitted_joins(pdf_pages: DataFrame, tokens: DataFrame, words: DataFrame) -> Perceptron:
    """The model of broken lines: all places where a clean word of letters can break, and all compounds, whose mark stays."""
    broken = tokens.where(r"w RLIKE '^\\p{L}{6,}$'").select("w", "n", F.explode(F.expr("sequence(2, length(w) - 3)")).alias("k"))
    broken = broken.selectExpr("left(w, k) AS l", "substr(w, k + 1) AS r", "'J' AS label", "greatest(1, 15 * n div (length(w) - 4)) AS n")
    clean = pdf_pages.where("text_source = 'TEXT_LAYER' AND raw_text IS NOT NULL")
    pairs = clean.select(F.explode(F.regexp_extract_all("raw_text", F.lit(r"([\p{L}\p{N}]+-[\p{L}\p{N}]+)"), 1)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    parts = broken.unionByName(pairs.selectExpr("substring_index(w, '-', 1) AS l", "substring_index(w, '-', -1) AS r", "'K' AS label", "120 * n AS n"))
    parts = parts.withColumn("lr", F.concat("l", "r"))
    for name in ("lr", "l", "r"):
        held = words.select(F.col("word").alias(f"{name}_key"), F.lit(True).alias(f"{name}_held"))
        parts = parts.withColumn(f"{name}_key", _key(name)).join(held, f"{name}_key", "left").withColumn(f"{name}_known", F.col(f"{name}_held").isNotNull() | F.col(name).rlike("^[0-9]+$"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for left, right, label, n, *known in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                for mark in BREAK_MARKS:
                    rows["\x1f".join(join_features(left, mark, right, _state(*known))), label] += n * (7 if label == "K" and mark == "-" else 1)
            yield _columns([(*k, n) for k, n in rows.items()], ["features", "label", "n"], pa.string(), pa.string(), pa.int64())

    found = parts.select("l", "r", "label", "n", "lr_known", "l_known", "r_known").mapInArrow(features, "features string, label string, n bigint").groupBy("features", "label").agg(F.sum("n").alias("n")).collect()
    # kinds of joins are few, whatever the corpus
    total = sum(r.n for r in found)
    data = [(r.features.split("\x1f"), r.label) for r in sorted(found) for _ in range(1 + r.n * JOIN_REPEATS // total)]
    return Perceptron().train(data, 3) if data else Perceptron()


def fitted_margin(spark: SparkSession, editor: Editor, forms: DataFrame, words: DataFrame, rare: DataFrame, common: Common, packed: np.ndarray, confusions: Confusions, rate_scan: float, seed: int = 17) -> float:
    """The gain over keeping from which on an edit is more often right than wrong, by steps of a hundredth.

    Right edits come from all clean words, corrupted. Wrong ones come from all clean words that are not known
    but have a known neighbour. How often either stands among the unknown words of a scan is estimated from
    the rates of unknown words in scanned and in clean pages.
    """

    def corrupted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(form, made[0], key_of(made[0])) for form in batch.column(0).to_pylist() if (made := confusions.corrupt(form, random.Random(f"{seed} {form}")))]
            yield _columns(rows, ["wanted", "form", "form_key"], pa.string(), pa.string(), pa.string())

    known = words.select(F.col("word").alias("form_key"))
    unknown = lambda df: df.where("NOT form RLIKE '^[0-9]+$'").join(known, "form_key", "left_anti")
    step = F.floor(F.col("gain") * 100).alias("step")
    made = cut(unknown(forms.where("length(form) > 2").select("form").mapInArrow(corrupted, "wanted string, form string, form_key string")))
    got = corrections(spark, made.select("form", "form_key").distinct(), rare, editor, common, packed).where("text IS NOT NULL")
    right = Counter({r.step: r.n for r in made.drop("form_key").join(got, "form").withColumn("wanted_key", _key("wanted")).where(_key("text") == F.col("wanted_key")).groupBy(step).agg(F.count("*").alias("n")).collect()})
    clean = cut(unknown(forms))
    counts = clean.agg(F.count("*").alias("forms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    wrong = Counter({r.step: r.n for r in corrections(spark, clean.select("form", "form_key"), rare, editor, common, packed).where("text IS NOT NULL").groupBy(step).agg(F.count("*").alias("n")).collect()}) if counts.forms else Counter()
    rate_clean = counts.n / max(1, forms.agg(F.sum("n")).first()[0] or 0)
    share = min(1.0, max(0.0, 1 - rate_clean / rate_scan)) if rate_scan else 0.0  # of unknown words of a scan that are misread
    if not right:
        return float("inf")
    if not wrong:  # nothing tells against an edit
        return float("-inf")
    weight_right, weight_wrong = share / right.total(), (1 - share) / counts.forms
    best, margin = -1.0, float("-inf")
    for m in [float("-inf"), *sorted({*right, max(wrong) + 1})]:
        value = weight_right * sum(n for x, n in right.items() if x >= m) + weight_wrong * sum(n for x, n in wrong.items() if x < m)
        if value > best + 1e-9:
            best, margin = value, m / 100
    return margin


# ---- furniture --------------------------------------------------------------------------------

_NUMBERED = re.compile(r"^(?:page|p\.?|seite|halaman|hal\.?|página|стр\.?)?\s*[-\[(–]?\s*(?:[0-9OIlSBZ]{1,4}|[ivxlcdm1I]{1,8})\s*(?:(?:of|/|von|dari|de)\s*[0-9OIlSBZ]{1,4})?\s*[-\])–]?$", re.I)
_DOC_NUMBER = re.compile(r"[0-9OIlSBZ]{2}-[0-9OIlSBZ]{4}-[0-9OIlSBZ]{3}")
_NO_LETTER, _LETTERS, _FIGURES, _WIDE, _SPACES = re.compile(r"[\W_]+"), re.compile(r"[^\W\d_]+"), re.compile(r"[0-9.,]+"), re.compile(r"\S {2,}\S"), re.compile(" +")
_FOLD = str.maketrans("c0o1l5t6hqi2", "eaaiisfbbgiz")


def folded(text: str) -> str:
    """The letters of a line in classes of characters that are mistaken for each other."""
    text = text.lower().replace("ii", "u").replace("ri", "n").replace("cl", "d").replace("vv", "w").replace("rn", "m")
    return _NO_LETTER.sub("", text).translate(_FOLD)


def _near(a: str, b: str) -> float:
    """Share of the character pairs of a that occur in b."""
    pairs = {a[i : i + 2] for i in range(len(a) - 1)}
    other = {b[i : i + 2] for i in range(len(b) - 1)}
    return len(pairs & other) / len(pairs) if pairs else 0.0


def edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Indexes of non-blank lines from the top, and from the bottom."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return full, full[::-1]


#: Lines at the top and bottom of a page that the furniture model learns from.
EDGE_LINES = 4


def _repeat_key(line: str) -> int | None:
    own = re.sub(r"[0-9]", "", folded(line))
    if len(own) < 4:
        return None
    return xxhash.xxh64_intdigest(own) >> 1


class PageLines:
    """Features of the lines of a page that may be furniture."""

    def __init__(self, lines: list[str], header: str, footer: str, number: str, repeated: set[int]):
        self.lines, self.full, self.repeated = lines, edges(lines)[0], repeated
        self.width = max((len(lines[i].strip()) for i in self.full), default=1)
        self.head, self.foot, self.numbered = folded(header), folded(footer), folded(number)

    def features(self, rank: int) -> tuple[list[str], list[str]]:
        """Of the non-blank line of a rank from the top: (of position and form, of the fields of the page and its document)."""
        lines, full, n = self.lines, self.full, len(self.full)
        i, low = full[rank], n - 1 - rank
        line = lines[i].strip()
        words = _LETTERS.findall(line)
        top, bottom = f"t{min(rank, 4)}", f"l{min(low, 4)}"
        numeric, dotted = bool(_NUMBERED.match(line)), line[-1:] in ".,;:"
        form = [
            "N" if numeric else "D" if _DOC_NUMBER.search(line) else "S" if _FIGURES.fullmatch(line) else "U" if line.isupper() else "T",
            "." if dotted else "_",
            "s" if len(line) < 0.75 * self.width else "w",
        ]
        f = ["b", top, bottom, *form, f"{top}{form[0]}", f"{bottom}{form[0]}", "".join(form), f"{top}{''.join(form)}", f"{bottom}{''.join(form)}",
             f"gap{bool(_WIDE.search(line))}", f"lower{line[:1].islower()}", f"{top}lower{line[:1].islower()}", f"{bottom}lower{line[:1].islower()}",
             f"blank{top}{i + 1 < len(lines) and not lines[i + 1].strip()}", f"blank{bottom}{i > 0 and not lines[i - 1].strip()}", f"few{len(words) <= 6}{form[0]}", f"lc{(lower := min(6, sum(w.islower() for w in words)))}", f"{top}lc{lower}", f"{bottom}lc{lower}", f"lc{lower}{''.join(form)}",
             f"break{line[-1:] in BREAK_MARKS}", f"prev{rank > 0 and lines[full[rank - 1]].strip()[-1:] in BREAK_MARKS}", f"dash{' - ' in _SPACES.sub(' ', line)}",
             *(f"w{bottom}{w.lower()}" for w in words[:4] if low < 2), *(f"w{top}{w.lower()}" for w in words[:4] if rank < 2)]
        own = folded(line)
        near = max(_near(own, self.head), _near(own, self.foot)) if len(own) > 3 else 0.0
        same = bool(self.numbered) and own == self.numbered
        again = _repeat_key(line) in self.repeated
        g = [f"near{near > 0.9}{near > 0.7}", f"num{same}", f"rep{again}", f"{top}near{near > 0.7}", f"{bottom}near{near > 0.7}", f"{bottom}num{same}", f"{top}num{same}", f"rep{again}{form[1]}"]
        return f, g


def furniture_features(lines: list[str], header: str, footer: str, number: str, repeated: set[int]) -> dict[int, tuple[list[str], list[str]]]:
    """Of each line near an edge: (features of position and form, features from the fields of the page and its document)."""
    page = PageLines(lines, header, footer, number, repeated)
    n = len(page.full)
    return {page.full[rank]: page.features(rank) for rank in range(n) if rank < EDGE_LINES or n - 1 - rank < EDGE_LINES}


def furniture_labels(text: str, header: str, footer: str, number: str, repeated: set[int]) -> Iterator[tuple[list[str], list[str], str]]:
    """(features, features from fields, label) of the lines of a page: lines that the fields name are furniture; the
    others are not where all three fields are given, and never away from the edges."""
    lines = text.split("\n")
    feats = furniture_features(lines, header, footer, number, repeated)
    named = {i: g[0] != "nearFalseFalse" or "numTrue" in g for i, (_, g) in feats.items()}
    complete = bool(header and footer and number) and sum(named.values()) >= 3
    full, _ = edges(lines)
    place = {i: min(r, len(full) - 1 - r) for r, i in enumerate(full)}
    for i, (f, g) in feats.items():
        if named[i] or complete or place[i] >= 2:
            yield f, g, "F" if named[i] and place[i] < 3 else "B"


def line_examples(rows: list[tuple]) -> Iterator[tuple[list[str], str]]:
    """Of (features, features from fields, label, times): each line as it is, and without its fields."""
    for first, second, label, times in rows:
        f, g = first.split("\x1f"), second.split("\x1f")
        hidden = [x.replace("True", "False") if x.startswith(("near", "num", "rep")) or "near" in x or "num" in x else x for x in g]
        odd = xxhash.xxh64_intdigest(first) & 1
        for k in range(times):
            yield f + g, label
            yield f + hidden if (k + odd) % 2 else f, label
            if label == "B" and not {"lc4", "lc5", "lc6"}.isdisjoint(f):  # a sentence may open several pages of a document
                yield f + [x.replace("repFalse", "repTrue") for x in hidden], label


def fitted_furniture(pages: DataFrame) -> Perceptron:
    """The furniture model, from all scanned pages with their repeated lines; equal lines are one row, repeated by the root of their number."""

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for text, header, footer, number, repeated in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows.update(("\x1f".join(f), "\x1f".join(g), label) for f, g, label in furniture_labels(text, header or "", footer or "", number or "", set(repeated or ())))
            yield _columns([(*k, n) for k, n in rows.items()], ["first", "second", "label", "n"], pa.string(), pa.string(), pa.string(), pa.int64())

    rows = pages.select("raw_text", "header_text", "footer_text", "page_number", "repeated").mapInArrow(labels, "first string, second string, label string, n bigint")
    return fitted(cut(rows.groupBy("first", "second", "label").agg(F.ceil(F.sqrt(F.sum("n"))).alias("times"))), line_examples, 6, 7)


def furniture_lines(lines: list[str], header: str, footer: str, number: str, repeated: set[int], model: Perceptron) -> set[int]:
    """Furniture stands outside of the body: from each edge inwards, up to the first line that is none."""
    page = PageLines(lines, header, footer, number, repeated)
    out: set[int] = set()
    for order in (range(len(page.full)), range(len(page.full) - 1, -1, -1)):
        for rank in order:
            f, g = page.features(rank)
            if model.lead(f, "F", "B") + model.lead(g, "F", "B") <= 0:
                break
            out.add(page.full[rank])
    return out


# ---- pages ------------------------------------------------------------------------------------


class Repairer:
    """The models of lines, as the workers use them. What is known of a page's words comes with the page."""

    def __init__(self, joins: Perceptron, furniture: Perceptron):
        self.joins, self.furniture = joins, furniture

    def joined(self, left: str, mark: str, right: str, state: str) -> bool:
        return self.joins.lead(join_features(left, mark, right, state), "J", "K") > 0

    def marks(self, text: str, header: str, footer: str, number: str, repeated: set[int], unknown: dict[str, tuple[str, list[int]] | None]) -> tuple[list[str], set[int], dict[int, int], set[int], dict[int, list[tuple[int, int, str]]]]:
        """(lines, furniture, broken line -> the line it goes on in, misread lines, line -> corrections (start, end, new)).

        unknown: the forms of the page's words that are not known, with their correction where there is one.
        """
        lines = text.split("\n")
        away = furniture_lines(lines, header, footer, number, repeated, self.furniture)
        broken: dict[int, int] = {}
        misread: set[int] = set()
        skip: dict[int, list[tuple[int, int]]] = defaultdict(list)
        fixes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        known = lambda w: form_of(w) not in unknown
        body = [i for i, x in enumerate(lines) if x.strip() and i not in away]
        for a, b in zip(body, body[1:], strict=False):
            pair = _broken(lines[a], lines[b])
            if not pair:
                continue
            tail, head = pair
            left, mark, right = tail[1], tail[2], head[1]
            whole, fixed = left + right, None
            if known(whole):
                join = self.joined(left, mark, right, _state(True, known(left), known(right)))
            elif (fixed := unknown[form_of(whole)]) is None:
                join = self.joined(left, mark, right, _state(False, known(left), known(right)))
            else:  # misread and broken: the join is judged by the corrected word
                join = not (known(left) and known(right)) and self.joined(left, mark, right, _state(True, known(left), known(right)))
            if join:
                broken[a] = b
                skip[a].append(tail.span(1))
                skip[b].append(head.span(1))
                if fixed:
                    misread |= {a if at < len(left) else b for at in fixed[1]}
                    fixes[a].append((*tail.span(1), _cased(fixed[0], whole)))
                    fixes[b].append((*head.span(1), ""))
        wanted = [(form, form.lower()) for form, fixed in unknown.items() if fixed]
        for i in body if wanted else ():
            low = lines[i].lower()
            if any(f in low for _, f in wanted):
                for m in _TOKEN.finditer(lines[i]):
                    if len(m[0]) > 1 and (fixed := unknown.get(form_of(m[0]))) and m.span() not in skip[i]:
                        misread.add(i)
                        fixes[i].append((*m.span(), _cased(fixed[0], m[0])))
        return lines, away, broken, misread, fixes

    def repaired(self, lines: list[str], away: set[int], broken: dict[int, int], misread: set[int], fixes: dict[int, list[tuple[int, int, str]]]) -> list[str]:
        """Continuous paragraphs."""
        out, current, glue = [], "", False
        body = [(i, x) for i, x in enumerate(lines) if i not in away]
        for i, line in body:
            if not line.strip():
                if current and not glue:
                    out.append(current)
                    current = ""
                continue
            for start, end, new in sorted(fixes.get(i, []), reverse=True):
                line = line[:start] + new + line[end:]
            line = re.sub(r"\s+", " ", line.strip())
            current = current + line if glue or not current else f"{current} {line}"
            glue = i in broken
            if glue:
                current = current.rstrip(BREAK_MARKS)
        if current:
            out.append(current)
        return out


def _cased(new: str, old: str) -> str:
    """A corrected form in the capitals of what was read."""
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def _broken(line: str, following: str) -> tuple[re.Match, re.Match] | None:
    """The last word of a line that may go on, with its mark, and the first word of the next line."""
    if line.rstrip()[-1:] not in BREAK_MARKS or not (tail := _TAIL.search(line)) or tail[1].isdigit() or _SPACELESS.search(tail[1]):
        return None
    head = _HEAD.match(following)
    return (tail, head) if head else None


def scanned(pdf_pages: DataFrame) -> DataFrame:
    """Pages that are not of a text layer."""
    return pdf_pages.where("raw_text IS NOT NULL AND text_source IS DISTINCT FROM 'TEXT_LAYER'").select("page_id", "doc_id", "raw_text", "header_text", "footer_text", "page_number")


def facts(spark: SparkSession, pages: DataFrame, common: Common) -> DataFrame:
    """(doc_id, page_id, line_key, form, form_key, n, alone): of each page the keys of its edge lines, the words that are
    not common, how often and how often not as the half of a broken word, and in a row without both the number of all words.

    One pass over the texts, written once. Words are forms of at least two characters in scripts with
    spaces; the two halves of a broken word count as one word too.
    """
    sent = spark.sparkContext.broadcast(common)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = sent.value, {}

        def rare(word: str) -> str | None:
            if word not in done:
                if len(done) > 200_000:
                    done.clear()
                done[word] = None if len(word) < 2 or word in known or _SPACELESS.search(word) else form_of(word)
            return done[word]

        for batch in batches:
            docs, ids, keys, forms, times, whole = [], [], [], [], [], []
            for page, doc, text, header, footer in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines = text.split("\n")
                full, _ = edges(lines)
                some = {lines[i] for i in full[:3] + full[-2:]}
                some |= {x for t in (header, footer) if t for x in (t, *re.split(r" {2,}", t))}
                found = sorted({k for x in some if (k := _repeat_key(x)) is not None})
                words = Counter(_TOKEN.findall(text))
                pairs = [pair for a, b in zip(full, full[1:], strict=False) if (pair := _broken(lines[a], lines[b]))]
                seen, halves = Counter({f: 0 for l, r in pairs if (f := rare(l[1] + r[1]))}), Counter(f for pair in pairs for m in pair if (f := rare(m[1])))  # noqa: E741
                for w, n in words.items():
                    if f := rare(w):
                        seen[f] += n
                own = sorted(seen)
                docs += [doc] * (len(found) + len(own) + 1)
                ids += [page] * (len(found) + len(own) + 1)
                keys += [*found, *[None] * (len(own) + 1)]
                forms += [*[None] * len(found), *own, None]
                times += [*[None] * len(found), *(seen[f] for f in own), sum(n for w, n in words.items() if len(w) > 1 and not _SPACELESS.search(w))]
                whole += [*[None] * len(found), *(seen[f] - halves[f] for f in own), None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(forms, pa.string()), pa.array([None if f is None else key_of(f) for f in forms], pa.string()), pa.array(times, pa.int64()), pa.array(whole, pa.int64())],
                names=["doc_id", "page_id", "line_key", "form", "form_key", "n", "alone"],
            )

    return cut(pages.select("page_id", "doc_id", "raw_text", "header_text", "footer_text").mapInArrow(look, "doc_id bigint, page_id bigint, line_key bigint, form string, form_key string, n bigint, alone bigint"))


def with_repeats(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages with the keys of their edge lines that recur on another page of the document (few a page)."""
    found = seen.where("line_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "page_id", "line_key").distinct()
    recur = found.groupBy("doc_id", "line_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "line_key")
    by_page = found.join(recur, ["doc_id", "line_key"]).groupBy("page_id").agg(F.collect_set("line_key").alias("repeated"))
    return pages.dropDuplicates(["page_id"]).join(by_page, "page_id", "left")


# ---- exact look-up of words -------------------------------------------------------------------


def _bits(word: str) -> list[int]:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + i * b) % FILTER_BITS for i in range(4)]


def candidate_filter(rare: DataFrame) -> np.ndarray:
    """A filter of fixed size over the words that are not common. It only spares joins: what passes is joined exactly."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {b for w in batch.column(0).to_pylist() for b in _bits(w)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int32())], names=["bit"])

    flags = np.zeros(FILTER_BITS, np.uint8)
    flags[rare.select("word").mapInArrow(positions, "bit int").distinct().toArrow().column("bit").to_numpy()] = 1
    return np.packbits(flags, bitorder="little")


def corrections(spark: SparkSession, forms: DataFrame, rare: DataFrame, editor: Editor, common: Common, packed: np.ndarray | None = None) -> DataFrame:
    """(form, text, at, gain): every unknown form with its best known correction, or null. forms: form, form_key, distinct.

    The editor's candidates go by rank up to the first common word; those before it are looked up in the
    rest of the vocabulary by a join, and the best one that is found counts.
    """
    packed = candidate_filter(rare) if packed is None else packed
    sent = spark.sparkContext.broadcast((editor, common, packed))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, bits = sent.value
        schema = pa.schema([("form", pa.string()), ("rank", pa.int32()), ("text", pa.string()), ("text_key", pa.string()), ("at", pa.list_(pa.int32())), ("gain", pa.float64()), ("sure", pa.bool_())])

        def rows(form: str) -> Iterator[tuple]:
            rank = 0
            for rank, (gain, text, at) in enumerate(own.candidates(form)):
                if text in known:
                    yield form, rank, text, None, at, gain, True
                    return
                key = key_of(text)
                if all(bits[b >> 3] >> (b & 7) & 1 for b in _bits(key)):
                    yield form, rank, text, key, at, gain, False
            yield form, rank + 1, None, None, None, None, True

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                out = [r for form in batch.column(0).slice(start, 2000).to_pylist() for r in rows(form)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    unknown = forms.join(rare.select(F.col("word").alias("form_key")), "form_key", "left_anti").select("form")
    proposed = unknown.mapInArrow(propose, "form string, rank int, text string, text_key string, at array<int>, gain double, sure boolean")
    checked = proposed.join(rare.select(F.col("word").alias("text_key"), F.lit(True).alias("held")), "text_key", "left").where("sure OR held")
    return checked.groupBy("form").agg(F.min_by(F.struct("text", "at", "gain"), "rank").alias("c")).select("form", "c.*")


def prepared(spark: SparkSession, pdf_pages: DataFrame) -> tuple[DataFrame, Repairer]:
    """(scanned pages with all that is known of their lines and words, the models of lines), fitted on all pages."""
    pages = scanned(pdf_pages)
    tokens = cut(clean_tokens(pdf_pages))
    words = cut(_vocabulary(tokens))
    top = words.orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    common = Common({r.word for r in top.select("word").collect()})
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    rare = words.join(F.broadcast(spark.createDataFrame([(w,) for w in common.words] or [("",)], "word string")), "word", "left_anti")
    packed = candidate_filter(rare)
    seen = facts(spark, pages, common)
    repeated = with_repeats(pages, seen)
    once = seen.where("line_key IS NULL").select("page_id", "form", "form_key", "n", "alone").distinct()
    unknown = cut(once.join(rare.select(F.col("word").alias("form_key")), "form_key", "left_anti").groupBy("form", "form_key").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone")))
    rates = unknown.agg(F.coalesce(F.sum(F.when(F.col("form").isNotNull(), F.col("n"))), F.lit(0)).alias("unknown"), F.coalesce(F.sum(F.when(F.col("form").isNull(), F.col("n"))), F.lit(0)).alias("all")).first()
    # a form can't be a known word in all but one place if it is longer by more than that place
    confusions = Confusions(confusions_of(unknown.where(f"alone > 0 AND length(form) BETWEEN 4 AND {longest + 2}"), words))
    forms = cut(clean_forms(tokens))
    editor = Editor(fitted(forms.select("form", (F.floor(F.log2("n")) + 1).alias("times")), lambda rows: word_examples(rows, confusions, 11), 3, 7), longest)
    editor.margin = fitted_margin(spark, editor, forms, words, rare, common, packed, confusions, rates.unknown / max(1, rates.all))
    fixed = corrections(spark, unknown.where("form IS NOT NULL").select("form", "form_key"), rare, editor, common, packed)
    by_page = once.where("form IS NOT NULL").select("page_id", "form").join(fixed, "form").groupBy("page_id").agg(F.collect_list(F.struct("form", "text", "at")).alias("unknown"))
    return repeated.join(by_page, "page_id", "left"), Repairer(fitted_joins(pdf_pages, tokens, words), fitted_furniture(repeated))


def _run(spark: SparkSession, pdf_pages: DataFrame, one, schema: str) -> DataFrame:
    pages, repairer = prepared(spark, pdf_pages)
    sent = spark.sparkContext.broadcast(repairer)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield one(own, batch)

    return pages.select("page_id", "raw_text", "header_text", "footer_text", "page_number", "repeated", "unknown").mapInArrow(repair, schema)


def _each(own: Repairer, batch: pa.RecordBatch):
    for page, text, header, footer, number, repeated, words in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
        unknown = {w["form"]: (w["text"], w["at"]) if w["text"] is not None else None for w in words or ()}
        yield page, own.marks(text, header or "", footer or "", number or "", set(repeated or ()), unknown)


def _columns(rows: list[tuple], names: list[str], *types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def defects(spark: SparkSession, pdf_pages: DataFrame) -> DataFrame:
    """(page_id, line_no, kind) of furniture, broken and misread lines of scanned pages."""

    def one(own: Repairer, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for page, (_, away, broken, misread, _) in _each(own, batch):
            rows += [(page, i, "FURNITURE") for i in sorted(away)] + [(page, i, "BROKEN") for i in broken] + [(page, i, "CHARS") for i in sorted(misread)]
        return _columns(rows, ["page_id", "line_no", "kind"], pa.int64(), pa.int32(), pa.string())

    return _run(spark, pdf_pages, one, "page_id bigint, line_no int, kind string")


def paragraphs(spark: SparkSession, pdf_pages: DataFrame) -> DataFrame:
    """(page_id, para_no, text): the repaired text of scanned pages."""

    def one(own: Repairer, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(page, j, text) for page, found in _each(own, batch) for j, text in enumerate(own.repaired(*found))]
        return _columns(rows, ["page_id", "para_no", "text"], pa.int64(), pa.int32(), pa.string())

    return _run(spark, pdf_pages, one, "page_id bigint, para_no int, text string")
