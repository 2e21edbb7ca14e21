"""Sentence units of every document, in scripts with and without spaces.

A text falls into blocks at blank lines; headings and list items are one unit each. In the other
blocks every terminator and, in Thai, every gap is a node of a lattice: ending a sentence there has a
cost, reading on has a cost, and so has a sentence that opens a quotation without closing it. The
cheapest path through the lattice gives the sentences. Runs of scripts without spaces (Thai, Chinese,
Japanese) are segmented by a word lattice; the words beside a gap (final particles, continuing words,
opening words) give its cost. The dictionary of the lattice is built from counts over the whole corpus:
what begins or ends runs often and goes on in different ways is a word; the listed particles cost less.

Defined results: null, empty and blank texts give no unit; a text without terminators is one unit;
positions count code points and exclude surrounding white space; a redelivered page counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that a word always follows, in the languages of the corpus.
TITLES = set("dr mr mrs ms prof messrs ing ir eng m mm mme mlle st dipl-ing dipl.-ing sr sra srta dra hr fr drs bpk h hj arch ten г-н г-жа проф инж".split())
NEVER_LAST = set(
    "fig figs sec sect no nos nr nrs abb tab tabl gbr tbl vs approx ca acc min max para art cap chap núm num aprox env d'env l'art dwg rev ref kap bd bzw cf eq vol pp pg p "
    "i.e e.g viz incl excl resp z d.h z.b d u.a a.l dr.-ing hlm ap c.-à-d éd ex q pág págs n nº vgl evtl ggf sog inkl zzgl jan feb mar apr jun jul aug sep sept oct nov dec "
    "рис гл п ок см табл стр разд ст т пп тов напр ред изд".split()
)
MAYBE_LAST = set("etc dll dst dsb usw co inc ltd corp p.m a.m pm am jr sr al д др т.д т.п т.е u.s.w n.m mm cm kg m bar".split())
LABEL_WORDS = set("rev rev. type class grade zone unit appendix annex anlage anhang ausgabe teil part option case table level".split())
GERMAN_MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
# Thai words by their part in a sentence.
THAI_FINAL = "ครับ ค่ะ คะ นะ จ้ะ แล้ว เลย ด้วย ฯลฯ".split()
THAI_GOES_ON = "และ หรือ ที่ ของ ใน โดย กับ จาก ต่อ เพื่อ ว่า คือ ให้ ถึง ตั้งแต่ ระหว่าง ภายใน ซึ่ง แต่ เพราะ จึง เป็น แก่ แด่ ด้าน เช่น อัน พร้อม รวมทั้ง ตาม เนื่องจาก".split()
THAI_OPENS = "การ ความ ผู้ ต้อง ควร ห้าม บันทึก ตาราง ตัวอย่าง เครื่อง ถัง วาล์ว ท่อ ปั๊ม หาก เมื่อ ถ้า โปรด กรุณา ก่อน หลัง ไม่ มี พบ เรา เขา ระบบ หัวข้อ ส่วน บริษัท โครงการ รายงาน เอกสาร".split()
# What goes on after a closed quotation in Japanese and Chinese, and words opening with the same sign.
CJK_GOES_ON = "と との という として が を に は も の で へ から まで や など 的 和 与 及 或 等".split()
CJK_OPENS = "とき ところ とくに ともに とりわけ では でも もし もっとも はじめ にも のち からだ 等待 和平".split()

_LIST_STRONG = re.compile(r"[ \t]*(?:[-–—•*·▪◦‣][ \t]+|\([a-zA-Z0-9]{1,3}\)[ \t]*|[a-zA-Z]\)[ \t]+|[0-9]{1,2}\)[ \t]+)")
_LIST_DOT = re.compile(r"[ \t]*([0-9]{1,2}|[a-zA-Z])\.[ \t]+")
_THAI = re.compile("[ก-๛]")
_NODE = re.compile(r"\.{2,}|[.!?…]+|[。！？｡]+")
_GAP = re.compile("(?<=[ก-๛”“\"»)0-9A-Za-z])[ \t \n]+(?=[ก-๛“\"«(])")
_OPEN, _CLOSE = "«„「『“‹", "»”」』›"
_QUOTE = re.compile('[«»„“”「」『』‹›"]')
_AFTER = re.compile(r"[)\]）】’']*")
_BEFORE = re.compile(r"(\S*)$")
_WORD = re.compile(r"[^\W\d_]+")

# What ends and what opens a sentence in Japanese and Chinese.
CJK_FINAL = "です ます でした ました ません である だ だった た る か ね よ ない ください 了 吗 呢 吧 啊 的 过 完".split()
CJK_OPENING = "この その また ただし なお しかし そして 次に 本 当 各 請 请 若 如 该 此 本 由于 因此 但 另外 同时 在 对".split()

#: Characters of the words that are counted at the ends of runs, places of a word of the dictionary, the share of its
#: places at which a word may go on in one and the same way, and the words that are sent to the workers.
EDGE, LEAST_PLACES, ONE_WAY, MOST_WORDS = 8, 5, 0.6, 20_000
#: Cost of a listed particle, of a word of the corpus and of an unknown character in the word lattice.
LISTED, COUNTED, UNKNOWN = 0.5, 1.1, 2.0
#: Cost of a sentence that leaves a quotation open, of the final particle, and of a gap beside a number.
UNBALANCED, NUMBER_GAP = 8.0, -10.0


class Lexicon:
    """The dictionary of the word lattice: cost by word."""

    def __init__(self, counted: tuple[str, ...] = ()):
        self.cost = dict.fromkeys(counted, COUNTED)
        self.cost.update({w: LISTED for group in (THAI_FINAL, THAI_GOES_ON, THAI_OPENS, CJK_GOES_ON, CJK_OPENS, CJK_FINAL, CJK_OPENING) for w in group})
        self.longest = max(map(len, self.cost))
        self.edges: dict[str, tuple[str, str]] = {}

    def words(self, run: str) -> list[str]:
        """The cheapest path through the word lattice of a run."""
        n = len(run)
        cost, back = [0.0] + [1e18] * n, [0] * (n + 1)
        for i in range(n):
            here = cost[i]
            if here + UNKNOWN < cost[i + 1]:
                cost[i + 1], back[i + 1] = here + UNKNOWN, i
            for j in range(i + 1, min(n, i + self.longest) + 1):
                c = self.cost.get(run[i:j])
                if c is not None and here + c < cost[j]:
                    cost[j], back[j] = here + c, i
        out = []
        while n:
            out.append(run[back[n] : n])
            n = back[n]
        return out[::-1]

    def ends(self, run: str) -> tuple[str, str]:
        """First and last word of a run without spaces."""
        if (got := self.edges.get(run)) is None:
            found = self.words(run) or [""]
            if len(self.edges) > 20_000:
                self.edges.clear()
            got = self.edges[run] = (found[0], found[-1])
        return got


_LISTED_ONLY = Lexicon()
_IN_USE = [_LISTED_ONLY]
_FINAL, _GOES_ON, _OPENS = set(THAI_FINAL), set(THAI_GOES_ON), set(THAI_OPENS)
_CJK_FINAL, _CJK_GOES_ON, _CJK_OPENING = set(CJK_FINAL), set(CJK_GOES_ON), set(CJK_OPENING)


def words_of(run: str) -> list[str]:
    return _IN_USE[0].words(run)


def _edges(run: str) -> tuple[str, str]:
    return _IN_USE[0].ends(run)


_THAI_RUN = re.compile("[ก-๛]+")
_CJK_RUN = re.compile("[ぁ-ヿ㐀-鿿々]+")
_CJK_GAP = re.compile("(?<=[ぁ-ヿ㐀-鿿])[ \t\u3000\n]+(?=[ぁ-ヿ㐀-鿿「『“])")
_SPACELESS_RUN = re.compile("[ก-๛]+|[ぁ-ヿ㐀-鿿々]+")


def _cjk_before(text: str, at: int) -> str:
    """The last word of the run that ends at a position; a lattice over as much of it as words have characters."""
    start = at
    while start and at - start < 2 * EDGE and _CJK_RUN.match(text[start - 1]):
        start -= 1
    return _edges(text[start:at])[1] if start < at else ""


def _cjk_after(text: str, at: int) -> str:
    run = _CJK_RUN.match(text, at, at + 2 * EDGE)
    return _edges(run[0])[0] if run else ""


def _cjk_weight(text: str, at: int, after: int, opened: str, gap: bool) -> float:
    """Chinese and Japanese: how strongly a terminator or, without one, a gap ends a sentence, by the words beside it."""
    w = -3.0 if gap else 4.0
    w += 2.0 if _cjk_before(text, at) in _CJK_FINAL else 0.0
    w += 2.0 if opened in _CJK_OPENING else -2.0 if gap and opened in _CJK_GOES_ON else 0.0
    return w


def _gap_weight(text: str, at: int, after: int) -> float:
    """Thai: how strongly the gap between two positions ends a sentence."""
    left, right = text[at - 1], text[after]
    if left.isdigit() or right.isdigit():
        return NUMBER_GAP
    w = 1.0
    if _THAI.match(left):
        start = at
        while start and _THAI.match(text[start - 1]):
            start -= 1
        last = _edges(text[start:at])[1]
        w += 3.0 if last in _FINAL else -5.0 if last in _GOES_ON else 0.0
    elif left.isalpha():
        w -= 2.0
    if run := _THAI_RUN.match(text, after):
        first = _edges(run[0])[0]
        w += 2.0 if first in _OPENS else -4.0 if first in _GOES_ON else 0.0
    return w


def _weight(text: str, start: int, at: int, mark: str, after: int, closed: bool) -> float:
    """How strongly the terminator text[at:at+len(mark)], with closers up to ``after``, ends a sentence."""
    end = len(text)
    if after >= end:
        return 10.0
    strong = mark[0] in "!?。！？｡"
    nxt = text[after]
    if mark[0] in "。！？｡":
        if closed:  # after a quotation: particles and commas go on
            if nxt in "，、,；;：:」』”)）":
                return -20.0
            return -8.0 if _cjk_after(text, after) in _CJK_GOES_ON else 3.0
        return -20.0 if nxt in "」』”)），、" else _cjk_weight(text, at, after, _cjk_after(text, after), False)
    space = nxt.isspace()
    i = after
    while i < end and text[i].isspace():
        i += 1
    if i >= end:
        return 10.0
    nxt = text[i]
    before = _BEFORE.search(text, max(start, at - 40), at)[1].lstrip("([{\"'«„“¿¡")
    token = before.lower()
    if "." in token and token not in NEVER_LAST and token not in MAYBE_LAST and token not in TITLES and token.rsplit(".", 1)[1].isalpha():
        before = before.rsplit(".", 1)[1]  # a sentence may end right before the word: "limits.Dr. Ellis"
        token = before.lower()
    letter = _WORD.match(text, i)
    upper = nxt.isupper() or bool(letter and nxt.islower() and len(letter[0]) > 1 and letter[0][1].isupper())
    if not space:
        if strong:
            return 3.0 if upper or nxt in "¿¡«„“\"" or ord(nxt) > 0x2E80 else -20.0
        # a full stop with a word right behind it: only a lower-case word or number before, a word in mixed case after
        if nxt in "¿¡«„“\"" and (before[-1:].islower() or before[-1:].isdigit() or before[-1:] == ")"):
            return 2.0 if token not in NEVER_LAST else -8.0
        if upper and letter and len(letter[0]) > 1 and letter[0][1:].islower() and (before[-1:].isdigit() or before[-1:] == ")" or len(before) > 1 and before[-1].islower()):
            known = token.split(".")[-1] if "." in token and token not in MAYBE_LAST else token
            return -8.0 if known in NEVER_LAST or known in TITLES or "@" in token else 2.0
        if upper and letter and len(letter[0]) == 1 and len(before) > 2 and before[-1].islower() and text[i + 1 : i + 2] in (" ", "'", "\n", "-"):
            return 2.0 if token not in NEVER_LAST and token not in TITLES else -8.0
        if upper and "-" in text[i : i + 5] and before[-1:].islower() and len(before) > 2 and token not in NEVER_LAST:
            return 2.0
        return -20.0
    if nxt in ",;:)]»”":
        return -20.0
    w = 3.0 if strong else 1.0 if len(mark) > 1 or mark[0] == "…" else 2.0
    if upper or nxt in "¿¡«„“\"" or ord(nxt) > 0x2E80 or 0xE00 <= ord(nxt) < 0xE80:
        w += 2.0
    elif nxt.isdigit():
        w += 1.0
    elif nxt.islower():
        w -= 8.0 if not strong else 6.0
    elif nxt in "([":
        w += 1.0 if text[i + 1 : i + 2].isupper() else -4.0
    if strong or len(mark) > 1 or closed:
        return w
    if token in TITLES and not (before.islower() and token in ("m", "mm", "h")):
        return -8.0
    if token in MAYBE_LAST:
        return w if upper or not nxt.isdigit() or token in ("mm", "cm", "m", "kg", "bar", "p.m", "a.m", "n.m") else w - 6.0
    if token in NEVER_LAST or token.split("-")[-1] in TITLES:
        return -8.0
    if len(before) == 1 and before.isalpha() and before.isupper():
        ahead = _BEFORE.search(text, max(start, at - 40), at - 1)
        previous = text[max(start, at - 40) : at - 1].split()
        return w if previous and previous[-1].lower() in LABEL_WORDS and ahead is not None else -5.0
    if before.isdigit():
        if not text[start : at - len(before)].strip():
            return -8.0  # the number of a heading or item
        if len(before) < 3 and int(before) <= 31 and letter and letter[0].lower() in GERMAN_MONTHS:
            return -8.0
    if len(before) == 2 and before[0] == "." or _THAI.search(before[-2:] or " ") and len(before) <= 3:
        return -8.0
    return w


def _prose(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Sentences of one block by the cheapest path through its terminator lattice."""
    piece = text[:end] if end < len(text) else text
    # quotation depth: at each quotation mark, the depth behind it
    marks: list[tuple[int, int]] = []
    depth, straight, stack = 0, False, []
    for m in _QUOTE.finditer(piece, start):
        c = m[0]
        if c == '"':
            straight = not straight
            depth += 1 if straight else -1
        elif c == "“" and stack and stack[-1] == "„":
            stack.pop()
            depth -= 1
        elif c in _OPEN:
            stack.append(c)
            depth += 1
        elif stack:
            stack.pop()
            depth -= 1
        marks.append((m.start(), depth))
    if depth:  # a quotation that never closes tells nothing
        marks = [(p, 0) for p, _ in marks]
    nodes: list[tuple[int, float, int]] = []  # position behind the sentence, weight, depth there
    k, inside = 0, 0
    spots = [(m.start(), m[0], False) for m in _NODE.finditer(piece, start)]
    if _THAI.search(piece, start):
        spots += [(m.start(), m[0], True) for m in _GAP.finditer(piece, start)]
        spots.sort()
    if _CJK_RUN.search(piece, start):
        spots += [(m.start(), m[0], True) for m in _CJK_GAP.finditer(piece, start)]
        spots.sort()
    for at, mark, gap in spots:
        while k < len(marks) and marks[k][0] < at:
            inside = marks[k][1]
            k += 1
        if gap:
            behind = at + len(mark)
            weight = _gap_weight(piece, at, behind) if _THAI.match(piece[at - 1]) or not _CJK_RUN.match(piece[at - 1]) else _cjk_weight(piece, at, behind, _cjk_after(piece, behind), True)
            nodes.append((at, weight, inside))
            continue
        after, closed, level, j = at + len(mark), False, inside, k
        while True:
            after = _AFTER.match(piece, after).end()
            # a closing mark may stand behind a space: « Attendre. »
            ahead = after
            while ahead < end and piece[ahead] in "     " and piece[ahead + 1 : ahead + 2] in ("»", "›"):
                ahead += 1
            if j < len(marks) and marks[j][0] == ahead and marks[j][1] < level:
                after, closed, level = ahead + 1, True, marks[j][1]
                j += 1
            else:
                break
        nodes.append((after, _weight(piece, start, at, mark, after, closed), level))
    # cheapest path; a state is the depth at the last end, so a path costs the same from each end at that depth
    best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
    back: list[int] = []
    skipped = 0.0
    for i, (_, weight, level) in enumerate(nodes):
        cost, source = min((c + skipped + (0.0 if d == level else UNBALANCED), b) for d, (c, b) in best.items())
        back.append(source)
        cost += max(0.0, -weight)
        skipped += max(0.0, weight)
        if level not in best or cost - skipped < best[level][0]:
            best[level] = (cost - skipped, i)
    i = min((c + (0.0 if d == 0 else UNBALANCED), b) for d, (c, b) in best.items())[1]
    ends = [end]
    while i >= 0:
        ends.append(nodes[i][0])
        i = back[i]
    out, at = [], start
    for stop in reversed(ends):
        a, b = at, stop
        while a < b and piece[a].isspace():
            a += 1
        while b > a and piece[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        at = stop
    return out


_ENDS = re.compile(r"[.!?…。！？:;,；：，、][\"»”’)\]」』]*$")


def _blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of non-blank lines, each line with its positions."""
    at, lines = 0, []
    for line in text.split("\n"):
        if line.strip():
            lines.append((at, at + len(line)))
        elif lines:
            yield lines
            lines = []
        at += len(line) + 1
    if lines:
        yield lines


def _units(text: str, lines: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """A block in parts: list items and leading headings by themselves, the rest together."""
    starts = [0]
    if len(lines) > 1:
        first = text[slice(*lines[0])]
        dotted = _LIST_DOT.match(first)
        number = dotted[1] if dotted else None
        width = max(b - a for a, b in lines)
        for i in range(1, len(lines)):
            a, b = lines[i]
            before, line = text[slice(*lines[i - 1])].rstrip(), text[a:b]
            item = _LIST_STRONG.match(line)
            if item and (i - 1 in starts and _LIST_STRONG.match(before) or _ENDS.search(before) or _LIST_STRONG.match(text[slice(*lines[starts[-1]])])):
                starts.append(i)
            elif number and (m := _LIST_DOT.match(line)) and (m[1].isdigit() and number.isdigit() and int(m[1]) == int(number) + 1 or m[1].isalpha() and number.isalpha() and ord(m[1]) == ord(number) + 1):
                starts.append(i)
                number = m[1]
            elif i == 1 and not item and not _ENDS.search(before) and not _LIST_STRONG.match(first):
                # a wrapped line has no room for the next word; a heading has
                word = line.split()[0]
                if len(before) + 1 + len(word) <= width and (word[0].isupper() or ord(word[0]) > 0x0E00 or word[0].isdigit()) and before.lstrip()[:1] and not before[-1:].isdigit():
                    starts.append(i)
    for i, k in enumerate(starts):
        last = starts[i + 1] - 1 if i + 1 < len(starts) else len(lines) - 1
        yield lines[k][0], lines[last][1]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text."""
    out: list[tuple[int, int]] = []
    for lines in _blocks(text or ""):
        for a, b in _units(text, lines):
            item = _LIST_STRONG.match(text, a, b)
            if item:  # an item with its marker is one unit
                x, y = a, b
                while text[x].isspace():
                    x += 1
                while text[y - 1].isspace():
                    y -= 1
                out.append((x, y))
            else:
                part = text[a:b]
                out += [(a + x, a + y) for x, y in _prose(part, 0, len(part))]
    return out


def corpus_words(texts: DataFrame) -> tuple[str, ...]:
    """Words of scripts without spaces by counts over all texts: the most frequent MOST_WORDS.

    texts: one text column. Beginnings and ends of runs are counted in each batch and added up; a beginning
    is a word if it goes on in different ways, an end if different things stand before it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = Counter(), Counter()
            for run, n in Counter(r for t in batch.column(0).to_pylist() for r in _SPACELESS_RUN.findall(t)).items():
                for k in range(1, min(EDGE, len(run)) + 1):
                    heads[run[:k]] += n
                    tails[run[-k:]] += n
            rows = [(side, g, n) for side, grams in ((0, heads), (1, tails)) for g, n in grams.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["side", "gram", "n"])

    some = texts.toDF("text").where(F.col("text").rlike("[ก-๛ぁ-ヿ㐀-鿿]"))
    counts = some.mapInArrow(count, "side int, gram string, n bigint").groupBy("side", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PLACES)
    longer = counts.where("length(gram) > 1").select("side", F.expr("CASE side WHEN 0 THEN left(gram, length(gram) - 1) ELSE substr(gram, 2) END").alias("gram"), "n").groupBy("side", "gram").agg(F.max("n").alias("one"))
    free = counts.join(longer, ["side", "gram"], "left").where((F.length("gram") > 1) & (F.length("gram") < EDGE) & (F.coalesce("one", F.lit(0)) <= ONE_WAY * F.col("n")))
    top = free.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(MOST_WORDS)
    return tuple(r.gram for r in top.collect())


def units(df: DataFrame, kind: str, key: str, column: str, counted: tuple[str, ...] = ()) -> DataFrame:
    """(kind, rec_id, start_pos, end_pos) of the sentence units of a text column, with the words counted in the corpus."""
    sent = df.sparkSession.sparkContext.broadcast(counted)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _IN_USE[0] = Lexicon(sent.value)
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in sentence_spans(text):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["rec_id", "start_pos", "end_pos"])

    found = df.where(F.col(column).isNotNull()).select(F.col(key).cast("bigint"), column).mapInArrow(split, "rec_id bigint, start_pos int, end_pos int")
    return found.select(F.lit(kind).alias("kind"), "rec_id", "start_pos", "end_pos")


def corpus_units(pdf_pages: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Units of all text-layer pages and of all benchmark texts; redelivered pages fall together."""
    layer = pdf_pages.where("text_source = 'TEXT_LAYER'")
    cases = benchmarks.dropDuplicates(["case_no"])
    counted = corpus_words(layer.select("raw_text").unionByName(cases.select(F.col("document_text").alias("raw_text"))))
    pages = units(layer, "page", "page_id", "raw_text", counted).dropDuplicates(["rec_id", "start_pos"])
    return pages.unionByName(units(cases, "benchmark", "case_no", "document_text", counted))
