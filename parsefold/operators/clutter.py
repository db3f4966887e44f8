"""Spans of pages that are not prose: line rules, page rules, and their resolution.

A document is one row with an array of pages, so looking ahead, latching across pages
and resolving overlaps are array expressions: no shuffle, no join. Lines and spans carry
half-open offsets into their page, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.functions.arrays import exploded, scan, sums_before
from parsefold.functions.spans import match_spans
from parsefold.functions.text import has_one_of, is_author_year, is_next_section, is_reference_entry, is_reference_heading, let, trim, trim_start

SPAN = "struct<page:int,start:int,end:int,text:string,reason:string,prio:int>"
#: Rules by name, in the order in which they apply.
LINE_RULES = ("explicit", "numbered", "decoration", "separator", "note_label", "source", "page_number")
PAGE_RULES = ("citation", "author_year", "note_mark", "emphasis")
REFERENCES = "references"
ALL_RULES = (REFERENCES, *LINE_RULES, *PAGE_RULES)
_PRIO = {name: n for n, name in enumerate(ALL_RULES)}


def span(page: Column, start: Column, raw: Column, reason: str, rule: str) -> Column:
    """A span over the trimmed part of `raw`, which begins at `start`; null if blank."""

    def made(text: Column) -> Column:
        lead = F.char_length(raw) - F.char_length(trim_start(raw))
        begin = (start + lead).cast("int")
        return F.when(text != "", F.struct(page.cast("int").alias("page"), begin.alias("start"), (begin + F.char_length(text)).alias("end"), text.alias("text"), F.lit(reason).alias("reason"), F.lit(_PRIO[rule]).alias("prio")))

    return let(trim(raw), made)


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def present(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.isNotNull())


def rest_of(text: Column, used: Column) -> Column:
    return F.substring(text, F.char_length(used) + 1, F.char_length(text))


# ---------------------------------------------------------------- lines


def page_lines(text: Column, page: Column) -> Column:
    """array<struct<page, start, end, text, blank_before, edge>> of the lines of a page
    that are not blank: trimmed text and its offsets; whether a blank line stands
    before it (after another line); whether it is the first or last of three or more."""
    def placed(pieces: Column) -> Column:
        def line(piece: Column, at: Column) -> Column:
            start = at + F.char_length(piece) - F.char_length(trim_start(piece))
            return let(trim(piece), lambda bare: F.struct(start.alias("start"), (start + F.char_length(bare)).alias("end"), bare.alias("text")))

        return F.zip_with(pieces, sums_before(F.transform(pieces, lambda x: F.char_length(x) + 1)), line)

    def with_gaps(every: Column) -> Column:
        def gap(x: Column, i: Column) -> Column:
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.coalesce(F.get(every, i - 1)["text"] == "", F.lit(False)).alias("gap"))

        return F.filter(F.transform(every, gap), lambda x: x["text"] != "")

    def marked(found: Column) -> Column:
        many = F.size(found) >= 3
        return F.transform(found, lambda x, i: F.struct(page.cast("int").alias("page"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), (x["gap"] & (i > 0)).alias("blank_before"), (many & ((i == 0) | (i == F.size(found) - 1))).alias("edge")))

    lines = let(F.split(text, "\n", -1), placed)
    return let(let(lines, with_gaps), marked)


def lines_of(pages: Column) -> Column:
    """The lines of all pages of a document, in order."""
    return F.flatten(F.transform(pages, page_lines))


def in_references(lines: Column) -> Column:
    """For each line: does it belong to a reference list? One opens at a heading with an
    entry among the next five lines, across pages, and closes at a next section, an
    appendix or a short heading after a blank line."""

    def opens(x: Column, i: Column) -> Column:
        # Entries are looked for after headings alone.
        return is_reference_heading(x["text"]) & F.exists(F.slice(lines, i + 2, v.LOOK_AHEAD_LINES), lambda y: is_reference_entry(y["text"]))

    def closes(x: Column) -> Column:
        short = x["blank_before"] & x["text"].rlike(v.SHORT_HEADING) & (F.size(F.split(x["text"], rf"{v.S}+", -1)) <= v.SHORT_HEADING_WORDS)
        return is_next_section(x["text"]) | x["text"].rlike(v.APPENDIX) | short

    def latched(open_: Column) -> Column:
        # Ends are looked for inside a list alone.
        both = F.zip_with(lines, open_, lambda x, o: F.struct(x["text"].alias("text"), x["blank_before"].alias("blank_before"), o.alias("open")))
        every = scan(both, F.lit(False), lambda now, f: f["open"] | (now & ~closes(f)), "boolean")
        return F.when(F.exists(open_, lambda o: o), every).otherwise(open_)

    return let(F.transform(lines, opens), latched)


#: What a line may begin with that a rule looks at: no letter, or that of a word in a pattern
#: (paragraph, page, doi, http).
_MAY_BEGIN = r"[^\p{L}]|[PpDdHh]"


def line_spans(line: Column, rules: tuple[str, ...]) -> Column:
    """The spans of the rules that look at one line."""
    text, page, start = line["text"], line["page"], line["start"]

    def at_start(pattern: str, reason: str, rule: str, keep=None) -> Column:
        def found(m: Column) -> Column:
            made = span(page, start, m, reason, rule)
            return F.when((m != "") if keep is None else (m != "") & keep(m), made)

        return let(F.regexp_extract(text, pattern, 0), found)

    def label(m: Column) -> Column:
        rest = rest_of(text, m)
        return m.startswith("¶") | (rest == "") | rest.rlike(v.EXPLICIT_REST)

    def dash(m: Column) -> Column:
        rest = rest_of(text, m)
        return rest.rlike(v.DASH_REST) & ~rest.rlike(v.MATH_REST)

    def whole(condition: Column, reason: str, rule: str) -> Column:
        return F.when(condition, span(page, start, text, reason, rule))

    by_rule = {
        "explicit": lambda: [at_start(v.EXPLICIT_LABEL, v.PARAGRAPH_LABEL, "explicit", label)],
        "numbered": lambda: [at_start(v.NUMBERED_LABEL, v.PARAGRAPH_LABEL, "numbered")],
        "decoration": lambda: [at_start(v.BULLET, v.DECORATIVE_SYMBOL, "decoration"), at_start(v.DASH, v.DECORATIVE_SYMBOL, "decoration", dash), at_start(v.HEADING_OR_QUOTE, v.DECORATIVE_SYMBOL, "decoration")],
        "separator": lambda: [whole(text.rlike(v.RULER) | text.rlike(v.ORNAMENTS), v.DECORATIVE_SEPARATOR, "separator")],
        "note_label": lambda: [at_start(v.NOTE_LABEL, v.FOOTNOTE_LABEL, "note_label")],
        "source": lambda: [whole(text.rlike(v.SOURCE_IDENTIFIER), v.SOURCE_ID, "source")],
        "page_number": lambda: [whole(line["edge"] & text.rlike(v.PAGE_NUMBER), v.PAGE_NUMBER_REASON, "page_number")],
    }
    made = [x for name in LINE_RULES if name in rules for x in by_rule[name]()]
    if not made:
        return no_spans()
    return F.when(~F.substring(text, 1, 1).rlike(_MAY_BEGIN), no_spans()).otherwise(present(F.array(*made)))


# ---------------------------------------------------------------- marks inside a page


def before(text: Column, at: Column, n: int) -> Column:
    begin = F.greatest(at - n, F.lit(0))
    return F.substr(text, begin + 1, at - begin)


def after(text: Column, end: Column) -> Column:
    return F.substr(text, end + 1, F.char_length(text))


def citation_spans(text: Column, page: Column) -> Column:
    def one(m: Column) -> Column:
        end = m["start"] + F.char_length(m["match"])

        def judged(c: Column) -> Column:
            token = F.regexp_extract(c["before"], v.LAST_TOKEN, 1)
            code = (token != "") & ((F.char_length(token) < 3) | token.rlike(r"[\d_]"))
            kept = ~code & ~c["before"].rlike(v.STRUCTURE_BEFORE) & ~c["before"].rlike(v.CODE_BEFORE) & ~c["after"].rlike(v.STATEMENT_AFTER)
            open_, close = F.regexp_extract(c["before"], v.OPEN_BEFORE, 0), F.regexp_extract(c["after"], v.CLOSE_AFTER, 0)
            wrapped = (open_ != "") & (close != "")
            raw = F.when(wrapped, F.concat(open_, m["match"], close)).otherwise(m["match"])
            start = m["start"] - F.when(wrapped, F.char_length(open_)).otherwise(F.lit(0))
            return F.when(kept, span(page, start, raw, v.CITATION_MARKER, "citation"))

        return let(F.struct(before(text, m["start"], v.CITATION_LOOK_BACK).alias("before"), after(text, end).alias("after")), judged)

    return present(F.transform(match_spans(text, v.CITATION), one))


def author_year_spans(text: Column, page: Column) -> Column:
    found = match_spans(text, v.PARENTHESES, 1)
    return present(F.transform(found, lambda m: F.when(is_author_year(m["g1"]), span(page, m["start"], m["match"], v.AUTHOR_YEAR_CITATION, "author_year"))))


def note_mark_spans(text: Column, page: Column) -> Column:
    def one(m: Column) -> Column:
        token = F.regexp_extract(before(text, m["start"], v.FOOTNOTE_LOOK_BACK), v.NOTE_TOKEN, 1)

        def judged(c: Column) -> Column:
            word = (F.char_length(c["token"]) >= 3) & ~c["token"].rlike(r"\d") & ~c["token"].rlike(v.UNIT_OR_FUNCTION)
            kept = word & ~c["after"].rlike(v.OPERATOR_AFTER) & ((c["after"] == "") | c["after"].rlike(v.NOTE_AFTER))
            return F.when(kept, span(page, m["start"], m["match"], v.FOOTNOTE_MARKER, "note_mark"))

        return let(F.struct(token.alias("token"), after(text, m["start"] + F.char_length(m["match"])).alias("after")), judged)

    return present(F.transform(match_spans(text, v.NOTE_MARK), one))


def emphasis_spans(text: Column, page: Column) -> Column:
    """Two spans for each pair of marks, its opening and its closing one."""

    def one(m: Column) -> Column:
        close = m["start"] + F.char_length(m["match"]) - F.char_length(m["g1"])
        return F.array(*[span(page, at, m["g1"], v.FORMATTING_MARKER, "emphasis") for at in (m["start"], close)])

    return present(F.flatten(F.transform(match_spans(text, r"(?=[*_~])" + v.EMPHASIS, 1), one)))


_PAGE_SPANS = {"citation": citation_spans, "author_year": author_year_spans, "note_mark": note_mark_spans, "emphasis": emphasis_spans}
#: One of these stands in every match of a rule.
_MARKS = {"citation": "[", "author_year": "(", "emphasis": "*_~"}


def page_spans(text: Column, page: Column, rules: tuple[str, ...]) -> Column:
    def found(name: str) -> Column:
        # No note mark is ASCII.
        lacking = ~has_one_of(text, *_MARKS[name]) if name in _MARKS else F.octet_length(text) == F.char_length(text)
        return F.when(lacking, no_spans()).otherwise(_PAGE_SPANS[name](text, page))

    made = [found(name) for name in PAGE_RULES if name in rules]
    return F.concat(*made) if made else no_spans()


# ---------------------------------------------------------------- all rules, and resolution


def raw_spans(pages: Column, rules: tuple[str, ...] = ALL_RULES) -> Column:
    """All spans of all rules, a bag."""

    def with_lines(lines: Column) -> Column:
        refs = in_references(lines) if REFERENCES in rules else F.transform(lines, lambda x: F.lit(False))

        def of(x: Column, listed: Column) -> Column:
            whole = F.array(span(x["page"], x["start"], x["text"], v.REFERENCE_LIST, REFERENCES))
            return F.when(listed, whole).otherwise(line_spans(x, rules))

        return F.flatten(F.zip_with(lines, refs, of))

    marks = F.flatten(F.transform(pages, lambda p, i: page_spans(p, i, rules)))
    return F.concat(let(lines_of(pages), with_lines), marks)


def resolve(spans: Column) -> Column:
    """Spans in order, without those that begin before an earlier kept one of their page
    ends: a longer one comes first at its start, an earlier rule at the same span. A
    dropped span blocks nothing."""

    def ordered(a: Column, b: Column) -> Column:
        up = lambda x, y: F.when(x < y, -1).when(x > y, 1)
        return F.coalesce(up(a["page"], b["page"]), up(a["start"], b["start"]), up(b["end"], a["end"]), up(a["prio"], b["prio"]), F.lit(0))

    def keep(a: Column, s: Column) -> Column:
        free = (s["page"] != a["page"]) | (s["start"] >= a["end"])
        return F.struct(F.when(free, s["page"]).otherwise(a["page"]).alias("page"), F.when(free, s["end"]).otherwise(a["end"]).alias("end"), free.alias("kept"))

    def kept(every: Column) -> Column:
        first = F.struct(F.lit(-1).alias("page"), F.lit(0).alias("end"), F.lit(False).alias("kept"))
        states = scan(every, first, keep, "struct<page:int,end:int,kept:boolean>")
        both = F.filter(F.zip_with(every, states, lambda s, a: F.struct(s.alias("s"), a["kept"].alias("kept"))), lambda x: x["kept"])
        return F.transform(both, lambda x: x["s"])

    return let(F.array_sort(spans, ordered), kept)


def with_id(spans: Column) -> Column:
    """id: page:start:end:reason:text."""
    return F.transform(spans, lambda s: F.struct(F.concat_ws(":", s["page"], s["start"], s["end"], s["reason"], s["text"]).alias("id"), *[s[c].alias(c) for c in ("page", "start", "end", "text", "reason")]))


def omissions(pages: Column, rules: tuple[str, ...] = ALL_RULES) -> Column:
    """array<struct<id, page, start, end, text, reason>>: what is not read aloud."""
    return with_id(resolve(raw_spans(pages, rules)))


def with_omissions(documents: DataFrame, pages: str = "pages", out: str = "omissions", rules: tuple[str, ...] = ALL_RULES) -> DataFrame:
    return documents.withColumn(out, omissions(F.coalesce(F.col(pages), F.array().cast("array<string>")), rules))


def omission_rows(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each omission of documents(key, omissions)."""
    return exploded(documents, F.col("omissions"), key)
