"""Sentence boundaries in many scripts, entirely in SQL expressions.

Every step is a regular expression that keeps the number of code points, so offsets into the
worked text are offsets into the original:

1. private-use characters of the source are set aside, blank lines become a break of their own;
2. full stops of decimals, addresses, initials, abbreviations, ordinals and list numbers are
   masked with private-use placeholders, as are end marks inside a quotation or bracket except
   one right before its end;
3. a marker is put in after each end: by the terminators of the script (ideographic, Devanagari,
   Arabic, Urdu, Greek, Latin and Cyrillic), by spaces in Thai, at headings, before list marks and
   labels, and after short lines that stand alone without an end mark;
4. the text is split at the markers; offsets are summed up over the pieces, white space around
   them is left out, and the text of a sentence is cut from the original.

In cased scripts an end mark before a lower-case word ends nothing; in the others a quotation
followed by its attribution (a clause with a verb of saying) stays one sentence.

Defined results: null and blank texts have no sentences; equal rows give equal sentences; texts
of any length are processed whole; an empty table gives an empty result. Further columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from energraph.runtime import spread

MASK, INNER, SPACE, BREAK, END = "\uE000", "\uE001", "\uE002", "\uE00A", "\uE0FF"
#: Placeholders of paired marks: quotation, bracket, single quotation.
PAIRS = (("\uE010", "\uE011"), ("\uE012", "\uE013"), ("\uE014", "\uE015"))
OPEN, CLOSE = "".join(p[0] for p in PAIRS), "".join(p[1] for p in PAIRS)

# Abbreviations that never end a sentence, those that a number follows, verbs of
# saying after and before their subject, Thai units, and words after which an ordinal stands.
ABBREVIATIONS = (
    "Mr Mrs Ms Messrs Dr Prof St Ste Mt Mts Ft Rev Gen Sgt Capt Lt Col Maj Hon Gov Sen Rep Pres e.g i.e cf vs viz approx ca "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec "
    "bzw geb gest Hr Hrn Abb vgl sog evtl Dipl Ing MM Mme Mlle Mgr Sr Sra Srta Dra Dña Ud Uds aprox "
    "ул кв рис табл см ср ок род проф акад им стр гг тыс млн млрд "
    "κα Δρ Βλ σελ αρ π.χ डॉ सं प्रो पं श्री"
).split()
NUMBERED = "no nos fig figs vol vols pp ch chap sec eq tab art p pág págs núm núms Nr Bd Kap Str τόμ".split()
SAYING_LAST = "पूछा कहा बोला बोली पूछी 물었다 말했다 외쳤다 대답했다 썼다 پوچھا کہا بولا 言った 言いました 尋ねた 聞いた 答えた 叫んだ 書いた 说 说道 问 问道 喊 喊道 答 答道 写道 叫道 說 說道 問 問道 寫道".split()
SAYING_FIRST = "سأل سألت قال قالت صاح صاحت هتف هتفت أجاب أجابت رد".split()
THAI_UNITS = "เมตร กิโลเมตร เซนติเมตร กม ซม บาท คน ปี วัน เดือน ชั่วโมง นาที เปอร์เซ็นต์ ครั้ง แห่ง หลัง เล่ม ตัว กิโลกรัม กรัม ลิตร องศา ไร่".split()
ORDINAL_OF = "Jahrhundert Jahrhunderts Jahrhunderte Januar Februar März April Mai Juni Juli August September Oktober November Dezember Auflage Kapitel".split()

#: Lines of text are taken to be wrapped at no fewer characters than this.
WRAP = 58

_W = r"[\s\x85\p{Z}" + BREAK + "]"  # white space of any kind
_GAP = r"[\t\r \u00A0\u3000\u2000-\u200A]"  # white space within a line
_ENDS = "。！？｡।॥۔؟.!?…"
_CLOSERS = CLOSE + r"”’»」』）)\]】〉》"
_CJK = r"぀-ヿ㐀-鿿豈-﫿"
_THAI = r"฀-๿"
_WORD = r"\p{L}\p{M}\p{N}"


def _any(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True))


def _attribution() -> str:
    """What follows a closed quotation when a clause with a verb of saying ends the sentence."""
    clause = rf"[^{_ENDS}：:，、,،{OPEN}{END}\n{BREAK}]"
    return rf"{_W}*(?:{clause}{{1,40}}(?:{_any(SAYING_LAST)})|(?:{_any(SAYING_FIRST)}){_W}{clause}{{1,40}})[。！？.!।۔؟]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A step is a pattern, what to put in its place, and characters without which it cannot match.
#: Patterns start with what is rare and look behind afterwards, which keeps the scans short.
Step = tuple[str, str, str]


def _masks() -> list[Step]:
    capital = rf"(?={_W}+(?:[-*•–—]{_GAP})?[{OPEN}“„«¿¡\"]*\p{{Lu}})"
    # a unit after a number, and the Russian "and so on", may end a sentence before a capital
    unit = rf"(?!(?<=\d[ \u00A0]\p{{Ll}}\.){capital})(?!(?<=т[.{MASK}] [дп]\.){capital})"
    return [
        (r"[\uE000-\uE0FF]", "\uFFFD", ""),
        (rf"\n(?={_GAP}*\n)", BREAK, ""),
        (rf"[;\u037E](?<=\p{{IsGreek}}.)(?={_W}|[»”\"’)]|\z)", "?", ";\u037E"),
        (r"[.,٫](?<=\d.)(?=\d)", MASK, ""),
        (rf"\.(?=\d)(?<![{_WORD}.]\.)", MASK, ""),
        (rf"(?<![{_WORD}])(?=[\p{{L}}\p{{M}}.]{{1,6}}+\.|[\p{{L}}\p{{M}}.]{{2,8}}\.)((?iu:{_any(ABBREVIATIONS)}))\.", f"$1{MASK}", "."),
        (rf"(?<![{_WORD}])(?=\p{{L}}{{1,4}}\.{_W}*\d)((?iu:{_any(NUMBERED)}))\.", f"$1{MASK}", "."),
        (rf"(В \d{{1,4}} гг?)\.(?<![{_WORD}]В \d{{1,4}} г{{1,2}}\.)", f"$1{MASK}", "В"),
        (rf"(\p{{L}})\.(?<![{_WORD}.{MASK}]\p{{L}}\.){unit}", f"$1{MASK}", "."),
        (r"[.?!](?=[a-z0-9/])(?<=[a-z0-9/=].)", MASK, ""),
        (rf"(\p{{Lu}})\.(?<=[.{MASK}]\p{{Lu}}\.)", f"$1{MASK}", "."),
        (rf"\.(?<=[{_THAI}]\.)", MASK, _THAI),
        (rf"(?m)^(?<!{MASK}\n)({_GAP}*\d{{1,3}})\.(?={_GAP})", f"$1{MASK}", "."),
        (rf"(\d)\.(?<=(?<!\d)\d{{1,2}}\.)(?={_W}(?:{_any(ORDINAL_OF)})(?![{_WORD}]))", f"$1{MASK}", "."),
        (rf"[\t \u00A0](?={_GAP}*(?:[{_THAI}]+{_GAP}+)?ฯลฯ)", SPACE, "ฯ"),
        (rf"[\t \u00A0](?={_GAP}*[พค]{MASK}ศ)", SPACE, _THAI),
        (rf"[\t \u00A0](?<=\d.)(?=(?:{_any(THAI_UNITS)})(?![ะ-ู็-๎]))", SPACE, _THAI),
    ]


def _pairings() -> list[Step]:
    (qo, qc), (bo, bc), (so, sc) = PAIRS
    turned = rf"”(?<![{_WORD}{_ENDS},،]”)"  # opens a quotation in Urdu
    out = [(rf"{a}([^{x}{BREAK}]*){b}", f"{qo}$1{qc}", a[0]) for a, b, x in (("„", "[“”]", "„“”"), (turned, "“", "“”"), ("“", "”", "“”"), ("«", "»", "«»"), ("「", "」", "「」"), ("『", "』", "『』"), ('"', '"', '"'))]
    out += [(rf"‘([^‘’{BREAK}]*)’(?!\p{{L}})", f"{so}$1{sc}", "‘"), (rf"'(?<![{_WORD}]')([^'{BREAK}]*)'(?![{_WORD}])", f"{so}$1{sc}", "'")]
    out += [(rf"\(([^(){BREAK}]*)\)", f"{bo}$1{bc}", "("), (rf"（([^（）{BREAK}]*)）", f"{bo}$1{bc}", "（"), (rf"\[([^\[\]{BREAK}]*)\]", f"{bo}$1{bc}", r"\[")]
    for o, c in PAIRS:  # end marks with more of the quotation after them
        skip, rest = rf"{_ENDS}\s\x85\p{{Z}}{CLOSE}", rf"[^{o}{c}{_ENDS}]*"
        out.append((rf"({o}{rest}|\G(?<={INNER}){rest})[{_ENDS}](?=[{skip}&&[^{c}]]*[^{o}{skip}][^{o}{c}]*{c})", f"$1{INNER}", o))
    return out


def _ends() -> list[Step]:
    said, after, ahead = _attribution(), f"$1{END}", f"{END}$1"
    openers = rf"[{OPEN}“„«‘¿¡(\[*_\"']*[ \u00A0\u202F]?"
    upper = rf"(?:[–—-]{_GAP})?{openers}(?:\p{{Lu}}|\p{{Lt}}|\p{{N}}|\p{{Sc}}|\p{{Ll}}\p{{Lu}})"
    closed = rf"(?:[\u00A0\u202F]?[{_CLOSERS}\"])"
    # a number after an abbreviation at the end of a line belongs to the abbreviation
    number = rf"\n(?<!{MASK}\n)(?={_GAP}*\d{{1,3}}(?:{MASK}|[.)]){_GAP})"
    mark = rf"(?:[-*•·▪◦‣]{_GAP}|[–—]{_GAP}(?!\p{{Ll}}(?!\p{{Lu}}))|[A-Z]{{1,2}}\d{{1,3}}:{_GAP}|#{{1,6}}{_GAP})"
    # the first word of the next line would have fitted on this one, so the break is not a wrap
    words = "|".join(rf"[^\n{BREAK}]{{1,{WRAP - w}}}\n\S{{1,{w}}}(?:\s|{BREAK}|\z)" for w in range(4, 41, 4))
    fits = rf"(?=(?:{END})?[^\n{BREAK}]{{1,{WRAP - 4}}}\n)(?=(?:{END})?(?:{words}|[^\n{BREAK}]{{1,{WRAP // 2}}}\n[{_CJK}{_THAI}]))"
    ideographic, indic = "。！？｡…", "।॥۔؟"
    return [
        (BREAK, BREAK + END, ""),
        (rf"(?m)^({_GAP}*#{{1,6}}{_GAP}[^\n{BREAK}]*)(?=\n)", after, "#"),
        (rf"{number}|\n(?={_GAP}*{mark})", "\n" + END, r"\n"),
        (rf"(?m)^{fits}([^\n{BREAK}]*[^\s{_ENDS},;:，、：；{MASK}{BREAK}{END}])(?<!\p{{L}}[-\u00AD\u2010])(?={_GAP}*\n)", after, r"\n"),
        # ideographic
        (rf"([。！？｡]++)(?![{_ENDS}{_CLOSERS}，、,])", after, ideographic),
        (rf"([。！？｡…]++[{_CLOSERS}]++)(?![{_ENDS}，、,と]|って|{said})", after, ideographic),
        (rf"(…++)(?=[{_CJK}{OPEN}《])(?<=[{_CJK}]…{{1,6}})", after, "…"),
        # Devanagari, Arabic, Urdu
        (rf"([।॥۔؟]++)(?![{_ENDS}{_CLOSERS}\"])", after, indic),
        (rf"([।॥۔؟]++[{_CLOSERS}\"]++)(?![{_ENDS},،]|{said})", after, indic),
        # Latin, Cyrillic, Greek and whatever else uses their marks
        (rf"([.!?…]++{closed}*+)(?={_W}+{upper}|{_W}*(?:\z|{END}))", after, ""),
        (rf"([.!?…]++)(?={_W}+{openers}\p{{Lo}})", after, ""),
        (rf"([.!?…]++{closed}++)(?={_W}+{openers}\p{{Lo}})(?!{said})", after, ""),
        (rf"([.!?…]++{closed}*+)(?=[{OPEN}]?\p{{Lu}}[\p{{Ll}}\s])(?<=\p{{Ll}}\p{{Ll}}[.!?…{_CLOSERS}\"]{{1,8}})", after, ""),
        # Thai
        (rf"({_W})(?<=[{_THAI}][\s\S])(?={_W}*[{OPEN}]?(?:[{_THAI}]|\p{{Lu}}\p{{Ll}}))", ahead, _THAI),
        (rf"({_W})(?<=\d[\s\S])(?={_W}*[{_THAI}])", ahead, _THAI),
    ]


STEPS = _masks() + _pairings() + _ends()


def _apply(text: Column, step: Step) -> Column:
    pattern, to, needs = step

    def changed(t: Column) -> Column:
        return F.regexp_replace(t, F.lit(pattern), F.lit(to))

    if not needs:
        return changed(text)
    return _let(text, lambda t: F.when(F.rlike(t, F.lit(f"[{needs}]")), changed(t)).otherwise(t))


def marked(text: Column) -> Column:
    """The masked text with a marker after each sentence."""
    for step in STEPS:
        text = _apply(text, step)
    return text


def _total(lengths: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, start, n), F.lit(0), lambda a, x: a + x)


def spans(pieces: Column, body: Column | None = None) -> Column:
    """array<struct<start_at, end_at[, sentence]>> of the pieces without the white space around them.

    Earlier lengths are summed, and sentences cut from ``body``, over groups of about the square
    root of their number, so the work stays near linear for texts of very many sentences.
    """

    def group(p: Column, k: Column, lengths: Column, sums: Column, g: Column) -> Column:
        base = _total(sums, F.lit(1), g)

        def cut(start: Column, own: Column | None) -> Column:
            def one(piece: Column, i: Column) -> Column:
                at = _total(lengths, g * k + 1, i)
                lead = at + F.char_length(F.regexp_extract(piece, rf"^{_W}*+", 0))
                end = at + F.char_length(F.regexp_replace(piece, rf"{_W}++\z", ""))
                place = [(start + lead).alias("start_at"), (start + end).alias("end_at")]
                return F.struct(*place, *([F.substring(own, lead + 1, end - lead).alias("sentence")] if own is not None else []))

            return F.transform(F.slice(p, g * k + 1, k), one)

        if body is None:
            return _let(base, lambda start: cut(start, None))
        return _let(base, lambda start: _let(F.substring(body, start + 1, F.get(sums, g)), lambda own: cut(start, own)))

    def grouped(p: Column, k: Column, lengths: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / k).cast("int"))
        sums = F.transform(numbers, lambda g: _total(lengths, g * k + 1, k))
        return _let(sums, lambda s: F.flatten(F.transform(numbers, lambda g: group(p, k, lengths, s, g))))

    def sized(p: Column, lengths: Column) -> Column:
        return _let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), lambda k: grouped(p, k, lengths))

    every = _let(pieces, lambda p: _let(F.transform(p, lambda x: F.char_length(x)), lambda n: sized(p, n)))
    return F.filter(every, lambda x: x["end_at"] > x["start_at"])


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", *, with_text: bool = True) -> DataFrame:
    """(key, sentence_no, start_at, end_at[, sentence]): offsets in code points, the end excluded."""
    rows = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("body")))
    pieces = F.split(marked(F.col("body")), END, -1)
    cut = rows.select("key", spans(pieces, F.col("body") if with_text else None).alias("parts"))
    return cut.select("key", F.posexplode("parts").alias("sentence_no", "part")).select("key", "sentence_no", "part.*")
