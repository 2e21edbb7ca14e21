"""Personal information inside free text: found, typed and replaced.

What leaves the text is decided by what terms disclose, measured over the whole corpus.

Names have no form. Each capitalised term is counted, and counted again where it stands with a protected
entity that repeats it (the local part of a mail address nearby). The gain of information, log2 of
P(protected | term) / P(protected), tells how strongly the term reveals a person; terms beyond the
thresholds are protected and leave the text wherever they stand as a name, all others (towns, eponyms of
laws and tests, sentence openers) are kept.

Mail addresses, phone and identity numbers and street addresses have forms, which propose them. Each value
is then scored by the information its occurrence gives on whose document it is in, log2 of the number of
documents over those that hold the value: what stands in very many of them (the address in a letterhead,
a hotline) reveals nobody and is kept, what stands in few is protected.

A protected term is generalised to its type, the typed placeholder.

One pass over the texts gives proposals and counts, which are written; a second one finds the names.

Defined results: null and empty texts give no mention; overlapping finds give the one of the earlier
type in TYPES; positions count code points; equal documents are each reported; extra columns stay;
documents with one doc_id are one document, those without an id give no mention.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Types by precedence where finds overlap.
TYPES = ("EMAIL", "ID_NUMBER", "ADDRESS", "PHONE", "NAME")
#: Thresholds of disclosure: bits of information gained, share of a term's places that a protected entity repeats, and how often at least.
MIN_BITS, MIN_SHARE, MIN_LINKS = 2.0, 0.05, 2
#: Characters around a mail address in which its owner's name is looked for.
WINDOW = 60
#: A value of a form is public from so many documents and such a share of them on.
PUBLIC_DOCUMENTS, PUBLIC_SHARE = 50, 0.01
#: Protected terms that are sent to the workers; where there are more, the words of the texts are joined with them.
MOST_SENT = 1_000_000

# Words that stand before an identity number.
ID_LABELS = (
    "social security number|social security no|SSN|national identity number|national identity no|national insurance number|identity number|identity card|ID card|ID number|passport number|passport no|passport|tax number|tax ID|TIN|"
    "Ausweisnummer|Personalausweis|Reisepass|Steuer-ID|Steuernummer|Steueridentifikationsnummer|Sozialversicherungsnummer|NIK|nomor KTP|KTP|nomor paspor|paspor|NPWP|"
    "n° de sécurité sociale|numéro de sécurité sociale|passeport|carte d'identité|numéro fiscal|NIF|NIE|DNI|pasaporte|número de la seguridad social|passaporte|CPF|RG|cartão de cidadão|"
    "ИНН|СНИЛС|паспорт|身份证号|身份证|护照|マイナンバー|旅券番号|パスポート|เลขประจำตัวประชาชน|หนังสือเดินทาง"
)
# Titles before a name, with and without a full stop.
DOTTED_TITLES = "Mr Mrs Ms Miss Dr Prof Ir Ing Eng Dipl.-Ing Sr Sra Srta Mme Mlle".split()
WHOLE_TITLES = "Herr Herrn Frau Bapak Ibu Pak Bu Señor Señora Senhor Senhora Monsieur Madame господин госпожа г-н г-жа".split()
_TITLE_ENDS = tuple(w + dot for w in DOTTED_TITLES for dot in ("", ".")) + tuple(WHOLE_TITLES)
# Words of streets by language; they stand before or behind the street's own name.
STREET_BEHIND = "Road|Lane|Street|Drive|Avenue|Court|Close|Way|Place|Square|Terrace|Crescent|Boulevard|Rd|St|Ave|Dr|Ln|Blvd"
STREET_BEFORE = "Avda|Avenida|Av|Calle|C/|Plaza|Paseo|Camino|Carretera|Rua|Travessa|Praça|Largo|Estrada|Jalan|Jln|Jl|Gang|Gg|Dermaga"
STREET_FRENCH = "rue|avenue|boulevard|place|chemin|impasse|allée|quai|route"
#: Words that are no other part of speech; they may be written in lower case or with a large letter too.
STREET_PLAIN = set("road lane street avenue boulevard square terrace crescent avenida calle plaza paseo camino carretera rua travessa praça estrada jalan rue place chemin impasse allée quai route".split())
STREET_GERMAN = r"[A-ZÄÖÜ][\wäöüß-]*(?:str\.|straße|strasse|weg|allee|platz|gasse|ring|damm|ufer|Str\.|STR\.|STRASSE|WEG|ALLEE|PLATZ)|(?:Am|An der|Im|In der|Zum|Zur|Auf der|Auf dem|AM|IM|ZUM|ZUR) [A-ZÄÖÜ][\wäöüß-]+"



def spellings(words: str) -> str:
    """Alternatives of street words as listed and in capitals, of plain ones in lower case and with a large first letter too."""
    out: dict[str, None] = {}
    for w in words.split("|"):
        plain = w.lower() in STREET_PLAIN
        out.update(dict.fromkeys([w, w.upper(), *([w.lower(), w.capitalize()] if plain else [])]))
    return "|".join(sorted(out, key=lambda w: (-len(w), w)))


_BEHIND, _BEFORE, _FRENCH = spellings(STREET_BEHIND), spellings(STREET_BEFORE), spellings(STREET_FRENCH)
_SPELLED = {"behind": set(_BEHIND.split("|")), "before": set(_BEFORE.split("|")), "french": set(_FRENCH.split("|"))}
_NUMBERED = re.compile(r"(?:[0-9]|bis|ter),? $")
# what must surround the word of a street, by kind
_STANDS = {
    "behind": lambda text, a, b: text[a - 1 : a] == " " and not (text[b : b + 1].isalnum() or text[b : b + 1] == "_"),
    "before": lambda text, a, b: not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and text[b : b + 1] in (" ", "."),
    "french": lambda text, a, b: text[b : b + 1] == " " and bool(_NUMBERED.search(text, max(0, a - 6), a)),
}
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
_PLACE = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’-])*(?!\w)"
_TOWN = rf"{_PLACE}(?: {_PLACE}){{0,2}}"
_EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*(?:@| ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@])"
    r"|(?<![\w.+-])[A-Za-z0-9][\w.+%-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+(?!\w)"
)
_ID = re.compile(
    rf"(?:(?<![\w])(?:{ID_LABELS}))\s*(?:no|number|nummer|Nr|n\.?[°ºo])?\.?\s*[:：#]?\s*"
    r"((?:[A-Z]{1,3} ?)?[0-9][0-9A-Z]*(?:[ .\-/][0-9A-Z]*[0-9][0-9A-Z]*)*(?:[ -][A-Z](?![\w]))?)", re.I)  # fmt: skip
_PHONES = [
    r"\+[0-9]{1,3}(?:[ .\-/]?\(?[0-9]{1,5}\)?){1,6}",
    r"00[1-9][0-9]{0,2}(?:[ .\-/]\(?[0-9]{1,8}\)?){1,6}",
    r"\(0?[0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}",
    r"[2-9][0-9]{2}([.\- ])[0-9]{3}\1[0-9]{4}",
    r"0[1-9](?:[ .][0-9]{2}){4}",
    r"0[1-9][0-9]{1,3}[ ./\-][0-9]{3,4}[ .\-][0-9]{3,4}",
    r"0[1-9][0-9]{1,4}[ /\-][0-9]{5,8}",
    r"[6789][0-9]{2} [0-9]{2} [0-9]{2} [0-9]{2}",
]
_PHONE = re.compile(
    r"(?<![\w.,/@-])(?:" + "|".join(p.replace("([.\\- ])", "(?P<s>[.\\- ])").replace("\\1", "(?P=s)") for p in _PHONES) + r")(?![0-9A-Za-z])(?:,? ?(?:ext\.?|extension|x|Durchwahl|poste|ramal) ?[0-9]{1,6}(?![0-9]))?", re.I)
_EXTENSION = re.compile(r",? ?(?:ext|extension|x|Durchwahl|poste|ramal)", re.I)
_CUE_PHONE = re.compile(r"(?:tel|phone|telp|telepon|telefon|Telefon|téléphone|teléfono|telefone|llame[^.]{0,60}al|ligue[^.]{0,60}(?:no|para)|телефону|電話|电话|โทร)[.: ]*\s*([0-9][0-9 .\-/]{6,16}[0-9])", re.I)
_ADDRESSES = [
    # house number, street, town and postcode in English order
    rf"(?:(?:Unit|Flat|Suite|Apt\.?|UNIT|FLAT|SUITE) [0-9]+[A-Za-z]?, )?[0-9]+[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_BEHIND})\b\.?(?:, {_TOWN})?(?:,? (?:[A-Z]{{2}} )?(?:[0-9]{{5}}(?:-[0-9]{{4}})?|[A-Z]{{1,2}}[0-9][0-9A-Z]? ?[0-9][A-Z]{{2}}))?(?!\w)",
    rf"[0-9]+(?: (?:bis|ter))?,? (?:{_FRENCH}) (?:(?:de la|de l'|du|des|de|d'|DE LA|DE L'|DU|DES|DE|D') ?)?{_CAP}(?:[ -]{_CAP}){{0,3}}(?:, [0-9]{{5}} {_TOWN})?",
    rf"(?<!\w)(?:{_BEFORE})\.? (?:(?:de la|de los|de las|del|de|da|do|dos|das|DE LA|DEL|DE|DA|DO) )?{_CAP}(?: (?:de |da |do |del )?{_CAP}){{0,3}},?(?: No\.?| NO\.?| n\.?º)? [0-9]+[A-Za-z]?(?:/[0-9]+)?"
    rf"(?:, [0-9]+\.?[ºª°](?: [A-Z])?)?(?:, RT [0-9]+/RW [0-9]+)?(?:, (?:[0-9]{{4,5}}(?:-[0-9]{{3}})? )?(?!RT ){_TOWN}(?: [0-9]{{5}})?)?",
    rf"(?:{STREET_GERMAN}) [0-9]+ ?[a-zA-Z]?(?:, [0-9]{{5}} {_TOWN})",
]
# each form with the kind of word that every address of the form holds
_ADDRESS_FORMS = [(re.compile(a), kind) for a, kind in zip(_ADDRESSES, ("behind", "french", "before", None), strict=True)]
_GERMAN_TOWN = re.compile(r", [0-9]{5} ").search
_ADDRESS_ID = re.compile(rf"(?<!\w)(?:Jalan|Jln\.?|Jl\.?|Gg\.?|Gang) {_CAP}(?: {_CAP}){{0,3}} [IVXL0-9]+/[0-9]+(?:, RT [0-9]+/RW [0-9]+)?(?:, {_TOWN}(?: [0-9]{{5}})?)?")
# a name's word: capitalised or in capitals, perhaps hyphenated, or an initial; d' before it is looked at apart. The letter
# comes first in the pattern, as the engine looks for one much faster than it looks behind every place.
_LETTER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_NAME_WORD = re.compile(rf"[{_LETTER}](?<![\w@.+%-].)(?:[\wÀ-ž’'-]*[\wÀ-ž]|\.)")
_PARTICLE = re.compile(rf"[dD]['’](?=[{_LETTER}])(?<![\w@.+%-]..)")
_EPONYM = re.compile(r"['’]s? (?:equation|law|test|method|modulus|ratio|number|formula|rule|theorem|criterion|principle|scale)\b|['’]?s? (?:equation|law|test|method|modulus|ratio|number|formula|hardness|results?|impact|criterion|scale)\b|-(?:Gesetz|Versuch|Zahl|Test|Härte)", re.I)


def fold(word: str) -> str:
    """Letters in lower case without accents, as they stand in mail addresses."""
    word = word.replace("ß", "ss").replace("ø", "o").replace("Ø", "o").replace("ł", "l").replace("Ł", "l")
    if word.isascii():
        return re.sub(r"[^a-z]", "", word.lower())
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if c.isalpha())


_FOLDED: dict[str, str] = {}


def _fold(word: str) -> str:
    got = _FOLDED.get(word)
    if got is None:
        if len(_FOLDED) > 100_000:
            _FOLDED.clear()
        got = _FOLDED[word] = fold(word[:-2] if word[-2:] in ("'s", "’s") else word)
    return got


def _owner_parts(mail: str) -> tuple[set[str], set[str]]:
    """(words of the local part, words without their first or last letter, which may be an initial)."""
    local = re.split(r"@| ?\(at\)| ?\[at\]| at ", mail, maxsplit=1)[0].lower()
    words = {w for w in re.split(r"[^a-z]+", local) if len(w) > 2}
    return words, {x for w in words for x in (w[1:],) if len(x) > 3}


# ---- places to look at ------------------------------------------------------------------------

_MAIL_ANCHOR = re.compile(r"@|\(at\)|\[at\]| dot ")
#: Characters looked at around a mark of a mail address; a local part and a domain are shorter by rule.
MAIL_REACH = 400
_PHONE_CUES = "tel phone telp telepon telefon téléphone teléfono telefone llame ligue телефону 電話 电话 โทร".split()
_AUTOMATON: list = []


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses: each holds one of a few marks, so only what surrounds a mark is searched."""
    done = 0
    for m in _MAIL_ANCHOR.finditer(text):
        if m.start() < done:
            continue
        start = max(done, m.start() - MAIL_REACH)
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = m.end() + MAIL_REACH
        for hit in _EMAIL.finditer(text, start, min(len(text), end)):
            if hit.start() >= done:
                yield hit.span()
                done = hit.end()
        done = max(done, m.end())


def _marks(text: str) -> tuple[list[int], list[int], set[str]]:
    """(starts of identity labels, starts of phone cues, kinds of street words that occur), by one pass of an automaton."""
    if not _AUTOMATON:
        import ahocorasick

        words: dict[str, list] = {}
        for kind, listed in (("cue", _PHONE_CUES), ("label", ID_LABELS.split("|")), ("behind", STREET_BEHIND.split("|")), ("before", STREET_BEFORE.split("|")), ("french", STREET_FRENCH.split("|"))):
            for word in listed:
                words.setdefault(word.lower(), [len(word)]).append(kind)
        a = ahocorasick.Automaton()
        for word, value in words.items():
            a.add_word(word, tuple(value))
        a.make_automaton()
        _AUTOMATON.append(a)
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case would shift places
        return [m.start() for m in _ID.finditer(text)], [m.start() for m in _CUE_PHONE.finditer(text)], {"behind", "before", "french"}
    labels, cues, kinds = [], [], set()
    for end, (n, *found) in _AUTOMATON[0].iter(low):
        start = end - n + 1
        for kind in found:
            if kind == "label":
                labels.append(start)
            elif kind == "cue":
                cues.append(start)
            elif kind not in kinds and text[start : end + 1] in _SPELLED[kind] and _STANDS[kind](text, start, end + 1):
                kinds.add(kind)
    return sorted(set(labels)), sorted(set(cues)), kinds


def proposals(text: str, mails: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(type as a number, start, end) of everything with the form of an entity, given the mail addresses."""
    found = [(0, *span) for span in mails]
    labels, cues, kinds = _marks(text)
    for start in labels:
        m = _ID.match(text, start)
        if m and sum(c.isdigit() for c in m[1]) >= 5:
            found.append((1, *m.span(1)))
    for form, kind in _ADDRESS_FORMS:
        if kind in kinds if kind else _GERMAN_TOWN(text):
            found += [(2, *m.span()) for m in form.finditer(text)]
    if "before" in kinds:
        found += [(2, *m.span()) for m in _ADDRESS_ID.finditer(text)]
    for m in _PHONE.finditer(text):
        number = _EXTENSION.split(m[0], maxsplit=1)[0]
        if (11 if number.startswith("00") else 8) <= sum(c.isdigit() for c in number) <= 15:
            found.append((3, *m.span()))
    done = 0
    for start in cues:
        m = _CUE_PHONE.match(text, start) if start >= done else None
        if m:
            done = m.end()
            if 8 <= sum(c.isdigit() for c in m[1]) <= 15:
                found.append((3, *m.span(1)))
    return found


def value_of(kind: int, text: str) -> str:
    """A value in the form in which it is counted: digits of numbers, letters and digits of others."""
    return re.sub(r"[^0-9]", "", text) if kind == 3 else re.sub(r"[\W_]+", "", text.lower())


# ---- disclosure of terms ----------------------------------------------------------------------


def name_words(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, word, whether it is an initial) of each capitalised word; an end 's is no part of a place, d' before a word is."""
    out = []
    for m in _NAME_WORD.finditer(text):
        w, (start, end) = m[0], m.span()
        if start > 1 and text[start - 1] in "'’" and text[start - 2] in "dD" and _PARTICLE.match(text, start - 2) and not (len(w) == 2 and w[1] == "."):
            start, w = start - 2, text[start - 2 : end]
        if w[-2:] in ("'s", "’s"):
            end -= 2
        out.append((start, end, w, len(w) == 2 and w[1] == "."))
    return out


def counted_words(text: str) -> list[str]:
    """The words of ``name_words``, without their places."""
    words = _NAME_WORD.findall(text)
    return [w for _, _, w, _ in name_words(text)] if _PARTICLE.search(text) else words


def linked_terms(text: str, mails: list[tuple[int, int]], spots: list[tuple[int, int, str, bool]]) -> Counter:
    """Places of each capitalised term that a mail address nearby repeats; spots: the capitalised words."""
    linked: Counter = Counter()
    j = 0
    for a, b in mails:
        words, inner = _owner_parts(text[a:b])
        while j < len(spots) and spots[j][1] < a - WINDOW:
            j += 1
        i = j
        while i < len(spots) and spots[i][0] < b + WINDOW:
            start, end, word, _ = spots[i]
            i += 1
            if end <= a or start >= b:
                term = _fold(word)
                if len(term) > 2 and (term in words or term in inner):
                    linked[term] += 1
    return linked


#: Rows of the first pass: a proposal's number is its place in TYPES, these are counts.
TERM, DOCUMENTS = 9, 8


def first_pass(documents: DataFrame) -> DataFrame:
    """(kind, doc_id, start_pos, end_pos, value, n, linked), written once.

    A proposal (kind: its type's number) with its value; TERM: a term of a batch of texts with its places and those that a
    protected entity repeats; DOCUMENTS: the number of texts of a batch. Counts take a text once, however many copies
    there are of it: a document is a copy if an earlier one has its text. A copy's proposals have n = 0, others n = 1.
    """
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("value", pa.string()), ("n", pa.int64()), ("linked", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, linked, rows = Counter(), Counter(), []
            copies = batch.column(2).to_pylist()
            for key, text, copy in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), copies, strict=True):
                mails = list(_mails(text))
                if copy:
                    pass
                elif mails:
                    spots = name_words(text)
                    words.update([w for _, _, w, _ in spots])
                    linked.update(linked_terms(text, mails, spots))
                else:
                    words.update(counted_words(text))
                rows += [(kind, key, a, b, value_of(kind, text[a:b]), int(not copy), None) for kind, a, b in proposals(text, mails)]
            every: Counter = Counter()
            for word, n in words.items():
                if len(term := _fold(word)) > 2:
                    every[term] += n
            rows += [(TERM, None, None, None, t, n, linked[t]) for t, n in every.items()]
            rows.append((DOCUMENTS, None, None, None, None, copies.count(False), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    texts = documents.where("text <> '' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("h"))
    repeated = cut(texts.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("h", "first"))
    # repeated texts are few as a rule; where they are many, the join shuffles, and a text with very many copies is split at run time
    side = F.broadcast(repeated) if repeated.count() <= MOST_SENT else repeated
    marked = texts.join(side, "h", "left").select("doc_id", "text", F.expr("first IS NOT NULL AND first <> doc_id").alias("copy"))
    return cut(marked.mapInArrow(look, "kind int, doc_id bigint, start_pos int, end_pos int, value string, n bigint, linked bigint"))


def disclosure(looked: DataFrame) -> DataFrame:
    """(term, n, linked, bits) of the terms that a protected entity repeats somewhere, over all documents."""
    counts = looked.where(F.col("kind") == TERM).groupBy(F.col("value").alias("term")).agg(F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    return looked.sparkSession.sql(
        """SELECT term, n, linked, log2((linked / n) / (SELECT greatest(sum(linked), 1) / greatest(sum(n), 1) FROM {counts})) AS bits
           FROM {counts} WHERE linked > 0""", counts=counts)  # fmt: skip


def protected_terms(looked: DataFrame) -> DataFrame:
    """(term): terms whose disclosure exceeds the thresholds."""
    return disclosure(looked).where(f"bits >= {MIN_BITS} AND linked >= {MIN_LINKS} AND linked >= {MIN_SHARE} * n").select("term")


def protected_values(looked: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, bits): proposals whose values disclose in whose document they stand."""
    documents = looked.where(F.col("kind") == DOCUMENTS).agg(F.sum("n").alias("documents"))
    proposed = looked.where(F.col("kind") < DOCUMENTS)
    # of a value first its documents, so that a value in a third of them is counted in parts
    held = proposed.where("n = 1").select("kind", "value", "doc_id").distinct().groupBy("kind", "value").agg(F.count("*").alias("held"))
    scored = proposed.join(held, ["kind", "value"]).join(F.broadcast(documents))  # one row
    public = (F.col("held") >= PUBLIC_DOCUMENTS) & (F.col("held") >= PUBLIC_SHARE * F.col("documents"))
    return scored.where(~public).select("doc_id", "kind", "start_pos", "end_pos", F.log2(F.col("documents") / F.col("held")).alias("bits"))


# ---- names ------------------------------------------------------------------------------------


def titled(text: str, start: int) -> bool:
    """Whether a title stands before a place."""
    if not start or text[start - 1] != " ":
        return False
    before = text[max(0, start - 14) : start].rstrip()
    if not before.endswith(_TITLE_ENDS):
        return False
    return any(before.endswith(t) and not (before[: -len(t)][-1:].isalnum() or before[: -len(t)][-1:] == "_") for t in _TITLE_ENDS)


def runs(text: str, words: list[tuple[int, int, str, bool]], strong: list[bool]) -> list[tuple[int, int]]:
    """Spans of names: runs of protected words and initials, 'Surname, Given' too."""
    out, i = [], 0
    while i < len(words):
        if not (strong[i] or words[i][3]):
            i += 1
            continue
        j, comma = i, False
        while j + 1 < len(words) and (strong[j + 1] or words[j + 1][3]):
            gap = text[words[j][1] : words[j + 1][0]]
            if gap == ", " and strong[j] and strong[j + 1] and not comma:
                comma = True
            elif gap not in (" ", "\n", "\u00a0"):
                break
            j += 1
        # an initial at the end belongs only to 'Surname, Given M.'
        last = j
        while last > i and words[last][3] and "," not in text[words[i][0] : words[last][0]]:
            last -= 1
        if any(strong[i : last + 1]) and not _EPONYM.match(text, words[last][1]):
            out.append((words[i][0], words[last][1]))
        i = j + 1
    return out


class Terms:
    """The protected terms, exactly."""

    def __init__(self, terms: set[str]):
        self.terms, self.seen = terms, {}

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms, self.seen = terms, {}

    def holds(self, word: str) -> bool:
        """Whether a word as written, or each part of one with hyphens, is a protected term."""
        got = self.seen.get(word)
        if got is None:
            term = fold(word[:-2] if word[-2:] in ("'s", "’s") else word)
            got = len(term) > 2 and term in self.terms or "-" in word and all(fold(p) in self.terms and len(fold(p)) > 2 for p in word.split("-"))
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[word] = got
        return got


def names_in(text: str, terms: Terms) -> list[tuple[int, int]]:
    """Spans of names: runs of protected terms; after a title any capitalised word."""
    words = name_words(text)
    strong = [not initial and (terms.holds(w) or titled(text, start)) for start, _, w, initial in words]
    return runs(text, words, strong) if any(strong) else []


def _spans(batch_keys: list, found: Iterator[list[tuple[int, int]]]) -> pa.RecordBatch:
    rows = [(key, a, b) for key, spans in zip(batch_keys, found, strict=True) for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "start_pos", "end_pos"])


def names_by_set(spark: SparkSession, texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of names, the protected terms being few enough to be sent."""
    sent = spark.sparkContext.broadcast(Terms({r.term for r in terms.collect()}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield _spans(batch.column(0).to_pylist(), (names_in(t, own) for t in batch.column(1).to_pylist()))

    return texts.mapInArrow(search, "doc_id bigint, start_pos int, end_pos int")


def names_by_join(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of names, however many protected terms there are: the distinct words of each text are joined with them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {w for _, _, w, initial in name_words(text) if not initial}
                rows += [(key, t) for t in {_fold(p) for w in found for p in (w, *(w.split("-") if "-" in w else ()))} if len(t) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "term"])

    held = texts.mapInArrow(spread, "doc_id bigint, term string").distinct().join(terms, "term", "left_semi").groupBy("doc_id").agg(F.collect_list("term").alias("terms"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _spans(batch.column(0).to_pylist(), (names_in(t, Terms(set(held or ()))) for t, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))

    return texts.join(held, "doc_id", "left").select("doc_id", "text", "terms").mapInArrow(search, "doc_id bigint, start_pos int, end_pos int")


# ---- mentions ---------------------------------------------------------------------------------


def resolved(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping finds the one of the earlier type, then the longer, then the first; in order of place."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, a, b in sorted(set(found), key=lambda x: (x[0], -(x[2] - x[1]), x[1])):
        k = bisect.bisect_left(taken, (a, b))
        if k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b:
            continue
        taken.insert(k, (a, b))
        out.append((kind, a, b))
    return sorted(out, key=lambda x: x[1])


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a typed placeholder for each mention."""
    parts, at = [], 0
    for kind, a, b in spans:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*parts, text[at:]])


def mentions(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, found): of each document with any, its mentions in order, as array<struct<kind, a, b>>."""
    looked = first_pass(documents)
    texts = documents.where("text <> '' AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    terms = cut(protected_terms(looked))
    names = names_by_set(spark, texts, terms) if terms.count() <= MOST_SENT else names_by_join(texts, terms)
    every = protected_values(looked).select("doc_id", "kind", "start_pos", "end_pos").unionByName(names.select("doc_id", F.lit(TYPES.index("NAME")).alias("kind"), "start_pos", "end_pos"))
    by_document = every.groupBy("doc_id").agg(F.collect_list(F.struct("kind", F.col("start_pos").alias("a"), F.col("end_pos").alias("b"))).alias("found"))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "a", "b"), x, strict=True)) for x in resolved([(f["kind"], f["a"], f["b"]) for f in row])] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return by_document.mapInArrow(settle, "doc_id bigint, found array<struct<kind:int,a:int,b:int>>")


def found(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos) of every mention in every document."""
    one = mentions(spark, documents).select("doc_id", F.explode("found").alias("m"))
    return one.select("doc_id", F.element_at(F.array(*map(F.lit, TYPES)), F.col("m.kind") + 1).alias("pii_type"), F.col("m.a").alias("start_pos"), F.col("m.b").alias("end_pos"))


def redacted(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_mentions): the text of each document with typed placeholders."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(text, [(TYPES[m["kind"]], m["a"], m["b"]) for m in found]) if text and found else text for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n = [len(found or ()) for found in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "text", "n_mentions"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").join(mentions(spark, documents), "doc_id", "left").select("doc_id", "text", "found").mapInArrow(replace, "doc_id bigint, text string, n_mentions int")
