"""Each rule by a table of what it takes, what just misses and where its limits are; then
rules together, on pages a generator composes of atoms whose spans it knows; then lists of
references against a plain walk over lines."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parsefold.operators.clutter import ALL_RULES, with_omissions
from parsefold.operators.paging import make_documents, paginate_text, split_page
from parsefold.plans.speech import speech_plan

# A text, and of it what the rule alone omits: the pieces between braces. The first line of
# a rule's cases holds matches, the second near misses, the third lengths at the limits.
RULES = {
    "explicit": [
        ["{¶7} kelp", "{§§ 31–33:} Kelp", "{paragraph 8.} ‘kelp’", "{Paragraph 5}"],
        ["§7 kelp", "paragraph 8 kelp", "Paragraphs 8 Kelp", "kelp ¶7", "§ Kelp", "§ 8 3 Kelp"],
        ["{¶1234} kelp", "{¶1234}5 kelp", "¶¶¶1 kelp"],
    ],
    "numbered": [
        ["{8.} kelp", "{(8)} kelp", "{[8]} kelp", "  {8)} kelp"],
        ["8.kelp", "8 kelp", "(8 kelp", "kelp 8. kelp", "8.5 kelp"],
        ["{999.} kelp", "1000. kelp", "{[0]} kelp"],
    ],
    "decoration": [
        ["{◦}kelp", "{•▪} kelp", "{+} kelp", "{-} “kelp”", "{>} kelp", "{###} 8"],
        ["-kelp", "- 8 kelp", "* k¹ = 8", "+ kelp / kelp", "#kelp", ">> kelp"],
        ["{######} kelp", "####### kelp"],
    ],
    "separator": [
        ["{___}", "{- - -}", "{~*—}", "{†}", "{¶§¶}"],
        ["--", "- - kelp", "†8", "...", "==="],
        ["{━━━}", "━━"],
    ],
    "note_label": [
        ["{³} kelp", "{†‡} kelp"],
        ["³kelp", "3 kelp", "kelp ³ kelp", "* kelp"],
        ["{¹²³⁴⁵⁶⁷⁸⁹⁰} kelp", "³"],
    ],
    "source": [
        ["{doi:10.5555/kelp}", "{DOI : 10.5555/k.8}", "{http://dx.doi.org/kelp.}", "{https://doi.org/8}"],
        ["see doi:10.5555/kelp", "doi:10.5555/kelp bed", "https://kelp.org/10.5555", "doi:11.5555/kelp"],
        ["{doi:10.1234/k}", "doi:10.123/k", "{doi:10.123456789/k}", "doi:10.1234567890/k"],
    ],
    "page_number": [
        ["{Page 8}\nkelp\n{page 8 of 31}", "{PAGE  8}\nkelp\nkelp"],
        ["kelp\nPage 8\nkelp", "Page viii\nkelp\nPage 8 kelp", "Page 8 / 31\nkelp\nkelp"],
        ["Page 8\nkelp", "Page 8", "{Page 8}\n\nkelp\n\n{Page 9}"],
    ],
    "citation": [
        ["kelp{[8]} bends", "kelp {[8, 9;10–12]}.", "kelp {([8])} bends", "{[8]}"],
        ["kelp[x]", "k[8]", "kelp8[9]", "table [8]", "a set of kelp [8]", "kelp [8] = 9", "kelp [8] means"],
        ["kelp {[999]}", "kelp [1000]", "kelp [0]", "kelp {[8, 0]}", "set. Kelp {[8]}", "code" + " k" * 22 + " bed {[8]}"],
    ],
    "author_year": [
        ["kelp {(Abara, 1999)}.", "{(see van der Zee & Ito et al. 2004b: 8–9)}", "{(Ito 1850; Böhme, 1901, 1902a)}"],
        ["(abara, 1999)", "(Abara)", "(in 1999)", "(Abara, 1999, chapter 8)", "Abara (1999)"],
        ["{(Ito 1800)}", "(Ito 1799)", "{(Ito 2099)}", "(Ito 2100)", "(Ito 1999ab)"],
    ],
    "note_mark": [
        ["kelp{²} bends", "kelp.{†} Kelp", "(kelp{¹²})"],
        ["kelp²bends", "sin² kelp", "kelp² + kelp", "kelp8² bends", "²"],
        ["bed{²} bends", "be² bends", "bed{²}"],
    ],
    "emphasis": [
        ["{*}kelp{*}", "{__}kelp bed{__} bends", "({~~}kelp{~~})", "{**}*kelp*{**}"],
        ["* kelp*", "*kelp *", "kelp*bed*kelp", "_kelp", "~kelp~", "*kelp\nbed*"],
        ["{*}k{*}", "**", "{*}*{*}"],
    ],
}
# What the generator knows is checked rule by rule; a case with a rule's mark that another
# rule's cases hold is left to the generator.
CASES = [(rule, case) for rule, kinds in RULES.items() for kind in kinds for case in kind]


def unmarked(case):
    """The text of a case, and its spans."""
    text, spans, begin = "", [], 0
    for c in case:
        if c == "{":
            begin = len(text)
        elif c == "}":
            spans.append((begin, len(text)))
        else:
            text += c
    return text, spans


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for rule in RULES:
        own = [c for r, c in CASES if r == rule]
        rows = spark.createDataFrame([(i, [unmarked(c)[0]]) for i, c in enumerate(own)], "doc_id int, pages array<string>")
        for r in with_omissions(rows, rules=(rule,)).collect():
            out[rule, own[r.doc_id]] = [(o.start, o.end) for o in r.omissions]
    return out


@pytest.mark.parametrize("rule,case", CASES)
def test_a_rule_alone(found, rule, case):
    assert found[rule, case] == unmarked(case)[1]


def test_every_rule_has_cases():
    assert set(RULES) | {"references"} == set(ALL_RULES)


# ---------------------------------------------------------------- rules together

WORDS = "kelp tide rope lamp quay moss gull sail brine shoal".split()
NAMES = ["Abara", "Böhme", "Ito", "O’Hara-Lind"]


def phrase(draw, least=2):
    return " ".join(draw.choice(WORDS) for _ in range(draw.randrange(least, 9)))


def marked_phrase(draw):
    """A phrase that ends with a mark in braces, and what follows it."""
    year = draw.randrange(1800, 2100)
    mark = draw.choice([f"{{[{draw.randrange(1, 999)}]}}", f" {{([{draw.randrange(1, 99)}; {draw.randrange(99)}])}}", f"{{{draw.choice('¹²³†‡')}}}", f" {{({draw.choice(NAMES)} {year})}}", f" {{({draw.choice(NAMES)} et al., {year}c)}}"])
    return phrase(draw) + mark + draw.choice([".", ",", "!", ""]) + " " + phrase(draw)


def atom(draw):
    """A paragraph in which braces stand around all that is not read."""
    n = draw.randrange(1, 999)
    return draw.choice(
        [
            lambda: phrase(draw).capitalize() + ".",
            lambda: draw.choice([f"{{({n})}} ", f"{{[{n}]}} ", f"{{{n})}} ", f"{{¶{n}}} ", "{• }", "{## }", "{+ }", "{‡} "]).replace(" }", "} ") + phrase(draw),
            lambda: "{" + draw.choice(["-----", "* * *", "~~~", "‡‡", f"doi: 10.{1000 + n}/{n}"]) + "}",
            lambda: marked_phrase(draw),
            lambda: marked_phrase(draw) + "\n" + marked_phrase(draw),
            lambda: phrase(draw) + " {" + (m := draw.choice(["*", "**", "_", "~~"])) + "}" + phrase(draw) + "{" + m + "} " + phrase(draw),
            lambda: draw.choice([f"{n}.{n} {phrase(draw)}", f"q{n}² = {n} {phrase(draw)}", f"index[{n}] {phrase(draw)}", f"({phrase(draw)})"]),
        ]
    )()


def tidy(text):
    """White space squeezed, none before a sign that ends or parts."""
    out = ""
    for c in " ".join(text.split()):
        out = out[:-1] + c if c in ",.;:!?" and out.endswith(" ") else out + c
    return out


def kept(case):
    """What is read of a text with braces."""
    return "".join(part.rpartition("}")[2] for part in case.split("{"))


PAGES = [[[atom(random.Random(1000 * i + 10 * p + k)) for k in range(5)] for p in range(1 + i % 3)] for i in range(150)]


@pytest.fixture(scope="module")
def composed(spark):
    rows = [(i, ["\n\n".join(unmarked(a)[0] for a in page) for page in pages]) for i, pages in enumerate(PAGES)]
    made = with_omissions(make_documents(spark.createDataFrame(rows, "doc_id int, pages array<string>")))
    return [r for r in speech_plan(made).orderBy("doc_id").collect()]


def test_composed_pages_lose_exactly_what_is_marked(composed):
    for r, pages in zip(composed, PAGES):
        want = []
        for n, page in enumerate(pages):
            at = 0
            for a in page:
                text, spans = unmarked(a)
                want += [(n, at + x, at + y) for x, y in spans]
                at += len(text) + 2
        assert [(o.page, o.start, o.end) for o in r.omissions] == want, r.pages


def test_composed_pages_are_spoken_without_them(composed):
    for r, pages in zip(composed, PAGES):
        spoken = [tidy(kept(a)) for page in pages for a in page]
        # Of a paragraph that holds neither letter nor digit nothing is spoken.
        assert tidy(" ".join(q.text for q in r.queue)) == tidy(" ".join(x for x in spoken if re.search(r"\w", x)))
        assert [q.queue_index for q in r.queue] == list(range(len(r.queue)))
        heard = {q.source_index for q in r.queue}
        assert r.skipped == len(r.omissions) and r.spoken_words == sum(len(q.text.split()) for q in r.queue)
        assert all(tidy(kept(a)) == "" or heard for page in pages for a in page)


def test_offsets_lead_back_to_the_pages(composed):
    assert sum(len(r.omissions) for r in composed) > 500
    for r in composed:
        for o in r.omissions:
            assert r.pages[o.page][o.start : o.end] == o.text and o.id == f"{o.page}:{o.start}:{o.end}:{o.reason}:{o.text}"
        for p in r.passages:
            assert r.pages[p.page][p.start : p.end].replace("\n", " ") == p.text and len(p.text) <= 240


def test_what_is_restored_is_read(spark, composed):
    """Every other omission taken back: its braces count as none."""
    rows = [(r.doc_id, r.pages, [o.id for o in r.omissions[::2]]) for r in composed]
    made = with_omissions(make_documents(spark.createDataFrame(rows, "doc_id int, pages array<string>, back array<string>")))
    for how, plan in (("some", speech_plan(made, True, F.col("back"))), ("all", speech_plan(made, False))):
        for r, pages in zip(plan.orderBy("doc_id").collect(), PAGES):
            seen, out = 0, []
            for a in (a for page in pages for a in page):
                text, whole = "", True
                for part in a.split("{"):
                    inner, close, rest = part.rpartition("}")
                    if close:
                        back = how == "all" or seen % 2 == 0
                        text, whole, seen = text + inner * back, whole and back, seen + 1
                    text += rest
                # What nothing is cut from is spoken as it stands, be it marks alone.
                out.append(tidy(text) if whole or re.search(r"\w", text) else "")
            assert tidy(" ".join(q.text for q in r.queue)) == tidy(" ".join(out))


def test_pages_of_marks_alone_say_nothing(spark):
    rows = with_omissions(make_documents(spark.createDataFrame([(1, ["{___}\n\n{[3]}", "{††}\n\nTide"]), (2, ["{[3]}\n\n{◦}"])], "doc_id int, pages array<string>").withColumn("pages", F.transform("pages", lambda p: F.translate(p, "{}", "")))))
    got = {r.doc_id: r for r in speech_plan(rows).collect()}
    assert [(q.queue_index, q.source_index, q.text) for q in got[1].queue] == [(0, 3, "Tide")] and got[2].queue == []


# ---------------------------------------------------------------- lists of references

LINES = {
    "heading": ["References", "31. bibliography :", "WORKS CITED"],
    "entry": ["8. Abara K. Moss. 1998.", "Ito, T. Gulls. 2003b", "[3] Böhme et al. doi: 10.1000/k", "https://doi.org/10.1000/k"],
    "close": ["Appendix C", "4. Discussion – tide", "Chapter 8", "Glossary"],
    "short": ["Salt And Brine", "Quay"],
    "prose": ["The tide bent the kelp in 1998.", "in a lamp", "Moss and gulls and rope and sail and brine again", "8 lamps"],
}


def listed(lines):
    """Walk over (kind, blank line before, text): which lines a reference list holds. A
    heading that opens no list is a short one, if it has no number."""
    inside, out = False, []
    for i, (kind, gap, text) in enumerate(lines):
        if kind == "heading" and any(k == "entry" for k, _, _ in lines[i + 1 : i + 6]):
            inside = True
        elif kind == "close" or (gap and (kind == "short" or (kind == "heading" and text[0].isupper()))):
            inside = False
        out.append(inside)
    return out


def test_reference_lists_equal_a_walk_over_lines(spark):
    draw, cases = random.Random(8), []
    for _ in range(300):
        lines, pages = [], []
        for p in range(draw.randrange(1, 4)):
            page = []
            for _ in range(draw.randrange(1, 8)):
                kind, gap = draw.choice([*LINES, "entry", "prose"]), bool(page) and draw.random() < 0.4
                page.append((kind, gap, draw.choice(LINES[kind])))
            lines += page
            pages.append("\n".join(("\n" if gap else "") + text for _, gap, text in page))
        cases.append((pages, lines, [text for page in pages for text in page.split("\n") if text]))
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id int, pages array<string>")
    got = {r.doc_id: [o.text for o in r.omissions] for r in with_omissions(rows, rules=("references",)).collect()}
    for i, (_, lines, texts) in enumerate(cases):
        assert got[i] == [t for t, inside in zip(texts, listed(lines)) if inside]
    assert sum(map(bool, got.values())) > 100


# ---------------------------------------------------------------- pages and passages


def test_documents_without_text_are_refused_and_blank_pages_keep_numbers(spark):
    rows = spark.createDataFrame([(1, ["   "]), (2, None), (3, ["", "Moss", " ", "Gull"]), (4, ["x" * 1_000_001])], "doc_id int, pages array<string>")
    got = {r.doc_id: r for r in make_documents(rows).collect()}
    assert "No readable text" in got[1].error and "No readable text" in got[2].error and "1 million" in got[4].error
    assert [p.page for p in got[3].passages] == [1, 3]


def test_emphasis_spans_equal_another_engine(spark):
    import regex

    texts = ["a *b* **c d** __e__ ~~f~~ x*y*z", "**a*b** *no closing", "_ not _ this_ _this_", "*a*\n*b\nc* ***d***"] * 2
    rows = with_omissions(make_documents(spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "doc_id int, pages array<string>")), rules=("emphasis",))
    pattern = regex.compile(r"(?<![\p{L}\p{N}*_~])(\*{1,2}|_{1,2}|~~)(?=\S)([^\n]*?\S)\1(?![\p{L}\p{N}*_~])")
    for r in rows.collect():
        want = sorted(s for m in pattern.finditer(r.pages[0]) for s in ((m.start(), m.start() + len(m[1])), (m.end() - len(m[1]), m.end())))
        assert [(o.start, o.end) for o in r.omissions] == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n!。é😀\t", max_size=3000), st.integers(1, 9))
def test_nothing_is_lost(text, times):
    from parsefold.operators.paging import _SPACE

    bare = lambda s: re.sub(f"[{_SPACE}]", "", s)
    cleaned = re.sub(r"\n{3,}", "\n\n", re.sub(r"[\t ]+", " ", text * times)).strip(_SPACE)
    pages = paginate_text(cleaned)
    assert all(len(p) <= 5000 for p in pages) and bare("".join(pages)) == bare(cleaned)
    for page in pages:
        passages = split_page(page)
        assert bare("".join(p[3] for p in passages)) == bare(page)
        for _, start, end, chunk in passages:
            assert len(chunk) <= 240 and page[start:end].replace("\n", " ") == chunk


@pytest.mark.parametrize("sentence,blank,cut", [(60, 200, 60), (51, 200, 200), (52, 200, 52), (60, None, 60), (None, 200, 200), (None, 1, 1), (None, None, 240)])
def test_where_a_passage_ends(sentence, blank, cut):
    """At the last sentence's end after 50 characters, else the last blank, else the limit."""
    text = ["k"] * 600
    if blank:
        text[blank] = " "
    if sentence:
        text[sentence - 1 : sentence + 1] = [".", " "]
    chunks = [p[3] for p in split_page("".join(text))]
    assert len(chunks[0]) == cut and all(len(c) <= 240 for c in chunks)


def test_rules_can_be_chosen(spark):
    rows = make_documents(spark.createDataFrame([(1, ["8) Moss[31]."])], "doc_id int, pages array<string>"))
    assert [o.reason for o in with_omissions(rows, rules=("citation",)).first().omissions] == ["Citation marker"]
    assert len(ALL_RULES) == 12


def test_running_folds_equal_plain_ones_at_every_length(spark):
    from parsefold.functions.arrays import BLOCK, scan, sums_before

    lengths = [0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 5]
    rows = spark.createDataFrame([(n, [(7 * i + n) % 11 for i in range(n)]) for n in lengths], "n int, x array<int>")
    latest = scan(F.col("x"), F.lit(-1), lambda a, x: F.when(x > 5, x).otherwise(a), "int")
    for r in rows.select("n", "x", sums_before(F.col("x")).alias("sums"), latest.alias("latest")).collect():
        assert r.sums == [sum(r.x[:i]) for i in range(r.n)]
        assert r.latest == [next((x for x in reversed(r.x[: i + 1]) if x > 5), -1) for i in range(r.n)]


def test_each_row_is_evaluated_once(spark):
    """The plan of the speech queue holds one Arrow evaluation for passages and sorts spans
    once; a filter that the optimiser adds for a generator would repeat both."""
    from parsefold.plans.speech import queue_rows

    rows = spark.createDataFrame([(1, ["8) Moss grows [31]."])], "doc_id int, pages array<string>")
    plan = queue_rows(speech_plan(with_omissions(make_documents(rows))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_sort(") == 1
    assert sum(line.lstrip(" :+-*()0123456789").startswith("ArrowEvalPython") for line in plan.split("\n")) == 1


def test_a_document_of_a_million_characters_ends_in_seconds(spark):
    import time

    line = "8) Moss bent[31] (Ito, 1998) the _lamp_ away.\n\n"
    text = line * (990_000 // len(line))
    pages = paginate_text(re.sub("\n{3,}", "\n\n", text).strip())
    rows = spark.createDataFrame([(1, pages)], "doc_id int, pages array<string>")
    began = time.time()
    got = speech_plan(with_omissions(make_documents(rows))).select(F.size("omissions").alias("o"), "skipped", F.size("queue").alias("q"), "error").first()
    assert got.error is None and got.o == got.skipped == 5 * (990_000 // len(line)) and got.q == 990_000 // len(line)
    assert time.time() - began < 60
