"""Template residue, filler and error pages: slots are induced by aligning texts of one template, pages by the company their wordings keep.

All texts are read twice. The first pass counts, for every wording of a sentence (its last five words with numbers and
names as placeholders), how often it stands in running text and beside how many others, and finds the marks that may be
unfilled slots. The second pass, knowing the wordings that carry the running text and the contexts of the marks, finds
the wordings that stand apart and the ordinary values that fill the same contexts elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.llm.leakage import _passing, hash_filter
from landweave.session import cut, lookup_join

# Spellings of unfilled slots. First variable names in brackets, then instructions, defaults and blanks.
BRACKETED = (
    r"\{\{[^{}\n]{0,60}\}\}",
    r"\$\{[^{}\n]{1,60}\}",
    r"<%=?[^%\n]{1,60}%>",
    r"%\([^()\n]{1,40}\)[sd]",
    r"%[A-Za-z][A-Za-z0-9_.]*%",
    r"\{[A-Za-z][A-Za-z0-9_. ]{0,40}\}",
    r"\[\[[^\[\]\n]{1,60}\]\]",
    r"<<[^<>\n]{1,60}>>",
    r"@@[^@\s]{1,40}@@",
    r"##?[A-Za-z][A-Za-z0-9_.]*##?",
    r"__[A-Za-z][A-Za-z0-9_.]*__",
    r"\[(?![\d\s,.-]+\])[^\[\]\n]{2,60}\]",
    r"<(?![\s\d/])[^<>\n=]{1,40}(?<![\s/])>",
    r"\((?:please )?(?:fill in|insert|enter|add)[^()\n]{0,40}\)",
)
DEFAULTS = (r"\bundefined\b", r"\bNaN\b", r"\bnull\b", r"\bNULL\b", r"\bNone\b", r"\bTBD\b", r"\bTODO\b")
BLANKS = (r"\bX{2,4}(?:[/.-]X{2,4})+\b", r"\bXXX+\b", r"_{3,}", r"\.{6,}")
SLOT = "(?:" + "|".join(BRACKETED + DEFAULTS + BLANKS) + ")"
#: Words of a sentence that explains a template; they decide only where a wording occurs once and alignment is impossible.
EXPLAINS = r"(?i)template|placeholder|marks the|marked by|stands for|variable|filled in|field name"
#: As above where a variable name recurs with one wording, as explanations do.
EXPLAINS_OFTEN = EXPLAINS + r"|\bdenotes\b|\bsyntax\b|\bmeans\b|replaced (?:by|with)|written as"
_MARKS = r"(?i:sic|seal|stamp|signed|signature|illegible|unclear|torn|redacted|omitted)\W*[\]>]"
#: Spellings of variable names that no ordinary text or editorial mark ([sic], [illegible]) has.
NAMED = rf"^(?:\{{|\$\{{|<%|%\(|%[A-Za-z]|\[\[|<<|@@|##?[A-Za-z]|__[A-Za-z]|\(|[\[<](?!{_MARKS})(?:[^\]>]*_[^\]>]*|[A-Z][A-Z0-9 /.'-]{{2,}}|(?i:insert|enter|fill|add|your|applicant|owner)\b[^\]>]*)[\]>])"
# Defaults and blanks that stand where a value belongs, so that no filled twin is needed: after a label or preposition,
# not as ordinary words (null and void, none of the, undefined boundary), separator lines, dot leaders or masked digits.
_LABEL = r"(?:[:=]|(?i:\b(?:no\.|number|dated|date|village|khasra|plot|sheet|tehsil|district|shri|smt\.?|name|to|of|on|in|by|for|at|from)))\s*"
_AFTER = r"(?=\s*(?:[.,;:)!?।]|$)|\s+(?:(?!of none)of|in|on|at|to|for|by|from|was|is|has|were|corresponds)\b)"
STANDING = rf"\b(?:TBD|TODO|NaN|NULL)\b|{_LABEL}(?:\bundefined\b|\bnull\b|\bNone\b(?! of)){_AFTER}|\w\W{{0,3}}(?:_{{3,}}|\.{{6,}}(?!\s*\d)|\b(?<!\d[ /.-])X{{2,4}}(?:[/.-]X{{2,4}})+\b(?![ /.-]?[\dX])|\b(?<!\d[ /.-])XXX+\b(?![ /.-]?[\dX]))"
# Cues of error pages, script notices and filler. A cue alone decides nothing; see page_residue.
CUES = (
    r"javascript", r"\bscripts?\b", r"\bscripting\b", r"\bbrowser\b", r"\b[45]\d\d\b\W{0,3}(?:not|bad|forbidden|internal|service|gateway|unauthori|too many|method|request|error)", r"\bhttp\b", r"\berrors? \d", r"\bdenied\b", r"\bpermission\b", r"\bsession\b", r"\blog ?in\b", r"\bsign in\b", r"went wrong", r"page you", r"\bnot found\b", r"located on this", r"\bunavailable\b", r"\bin time\b", r"too many", r"try again", r"\breload\b", r"traceback", r"[a-z]exception\b", r"[a-z]error\b", r"connection (?:failed|refused|reset|timed)", r"\bmaintenance\b", r"timed? ?out\b", r"\bgateway\b", r"\bserver\b", r"\bupstream\b", r"\bcookies\b", r"\bcaptcha\b", r"\boops\b", r"-gw/", r"no longer exists",
    r"जावास्क्रिप्ट", r"स्क्रिप्ट", r"नहीं मिला।", r"पता जाँचें", r"त्रुटि", r"सर्वर", r"सत्र", r"लॉग ?इन",
    r"\blorem\b", r"\bipsum\b", r"asdf", r"qwer", r"\bplaceholder\b", r"\bsample text\b", r"\bdummy\b", r"\bfiller\b", r"goes here\b", r"in this box\b", r"before publishing", r"replace (?:it|this)", r"blindtext", r"नमूना पाठ", r"\b(\w+)(?: \1\b){2,}", r"\bx{3,}\b", r"\btest test\b",
)
CUE = "(?i)(?:" + "|".join(CUES) + ")"
#: A wording carries running text when it stands beside at least COMPANY others; the most frequent of these that together hold
#: RUNNING of the sentences in running text are the hubs. A hub holds more than HUB_SHARE of these sentences, so at most 2 000 000 hubs are sent.
COMPANY, RUNNING, HUB_SHARE = 4, 0.8, 5e-7
#: Chances of (standing in a paragraph with a hub, standing in a document without any) for residue, titles and running text.
RESIDUE, TITLE, PROSE = (0.02, 0.4), (0.02, 0.02), (0.85, 0.1)
#: Log odds of residue before its occurrences are looked at: without a cue, with one, and for sentences that repeat one word.
PLAIN_ODDS, CUE_ODDS, REPEATED_ODDS = -4.5, 0.0, 3.0
#: Occurrences of a wording count in full up to so many, beyond that by their shares: copies of one page are no independent evidence.
ENOUGH = 20
TAIL = 5
_MARK = "\u0001"
_MONTHS = frozenset("jan feb mar apr may jun jul aug sep oct nov dec january february march april june july august september october november december".split())
#: A text without any of these holds no slot.
_SIGNS = ("{", "[", "<", "%", "@@", "#", "__", "(", "....", "XX", "undefined", "NaN", "null", "NULL", "None", "TBD", "TODO")
_SENTENCE, _PARAGRAPH = re.compile(r"(?<=[.!?।])\s+"), re.compile(r"\n+")
_PUNCTUATION, _DIGITS = re.compile(r"([.,;:!?।()\"“”])"), re.compile(r"\d+(?:[.,/:-]\d+)*")
_slot, _named, _explains, _often, _standing, _cue = (re.compile(x) for x in (SLOT, NAMED, EXPLAINS, EXPLAINS_OFTEN, STANDING, CUE))
_default, _blank = re.compile("^(?:" + "|".join(DEFAULTS) + ")$"), re.compile("^(?:" + "|".join(BLANKS) + ")$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Cache(dict):
    """Results of a function by word, emptied when it grows large."""

    def __init__(self, make) -> None:  # noqa: ANN001
        super().__init__()
        self.make = make

    def __missing__(self, word: str):  # noqa: ANN204
        if len(self) > 500_000:
            self.clear()
        out = self[word] = self.make(word)
        return out


def _code(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


_NINE, _MARKED = np.uint64(_code("9")), np.uint64(_code(_MARK))
_MONTH_CODES = np.array(sorted(_code(m) for m in _MONTHS), dtype=np.uint64)


def _word_codes(word: str) -> tuple[int, ...]:
    """Codes of a word and the punctuation at it, numbers as 9, without case."""
    return tuple(_code(x) for x in _PUNCTUATION.split(_DIGITS.sub("9", word).lower()) if x)


def _tail_token(word: str) -> tuple[str, bool]:
    """(canonical word, may be a name): numbers, also with a letter or two, as 9."""
    if any(c.isdigit() for c in word):
        return ("9" if sum(c.isalpha() for c in word) <= 2 else _DIGITS.sub("9", word.lower())), False
    core = word.strip(".,;:!?।()\"“”'*_>")
    return core.lower(), core[:1].isupper() and core[1:].islower()


def _wording(sentence: str, tokens: _Cache) -> int:
    """Hash of the last words of a sentence; 0 without a letter."""
    words = [tokens[w] for w in sentence.split()[-TAIL:]]
    plain = [w for w, _ in words]
    if not any(c.isalpha() for w in plain for c in w):
        return 0
    return xxhash.xxh64_intdigest(" ".join("N" if named and i else w for i, (w, named) in enumerate(words))) >> 1


def paragraphs(text: str) -> list[list[str]]:
    """Sentences of every paragraph that has any."""
    split = ([s for s in _SENTENCE.split(p) if s.strip()] for p in _PARAGRAPH.split(text))
    return [p for p in split if p]


def _flat(sentences: list[str], words: _Cache) -> np.ndarray:
    """Codes of all sentences, three zeros between; dates and runs of numbers as one 9."""
    codes: list[int] = [0, 0, 0]
    for s in sentences:
        for w in s.split():
            codes += words[w]
        codes += (0, 0, 0)
    out = np.array(codes, dtype=np.uint64)
    nine = out == _NINE
    month = np.isin(out, _MONTH_CODES)
    month[1:-1] &= nine[:-2] & nine[2:]
    out = out[~month]
    nine = out == _NINE
    nine[1:] &= nine[:-1]
    nine[0] = False
    return out[~nine]


def _contexts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of the two words on either side, hash of the three words before) of every word."""
    at = np.nonzero(c)[0]
    with np.errstate(over="ignore"):
        both = ((c[at - 2] * _BASE + c[at - 1]) * _BASE + c[at + 1]) * _BASE + c[at + 2]
        left = ((c[at - 3] * _BASE + c[at - 2]) * _BASE + c[at - 1]) * _BASE + np.uint64(1)
    return at, both, left


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as columns of the schema's types: whole numbers beside nulls must not pass through floats."""
    kinds = {"long": "Int64", "int": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pd.DataFrame({name: pd.array(list(values), dtype=kinds[kind]) for (name, kind), values in zip(fields, columns, strict=True)})


_SURVEY = "wording long, beside long, n long, doc_key string, fp long, both long, left long, led boolean, name long, word_like boolean, blank boolean, explains boolean, alone boolean"


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (wording, beside, n) of sentences in running text, summed per batch, and one row per mark (doc_key, fp, ...)."""
    tokens, words = _Cache(_tail_token), _Cache(_word_codes)
    for pdf in batches:
        pairs: dict[tuple[int, int], int] = {}
        marks: list[tuple] = []
        for key, text in zip(pdf["doc_key"], pdf["t"], strict=True):
            parts = paragraphs(text)
            for part in parts:
                if len(part) > 1:
                    tails = [_wording(s, tokens) for s in part]
                    for a, b in zip(tails, tails[1:], strict=False):
                        pairs[a, b] = pairs.get((a, b), 0) + 1
                        pairs[b, a] = pairs.get((b, a), 0)
                    pairs[tails[-1], 0] = pairs.get((tails[-1], 0), 0) + 1
            if any(sign in text for sign in _SIGNS):
                fp = xxhash.xxh64_intdigest(text) >> 1
                for s in (s for part in parts for s in part):
                    found = _slot.findall(s)
                    if found:
                        marks += [(key, fp, *m) for m in _marks(s, found, words)]
        rows = [(a, b, n, None, None, None, None, None, None, None, None, None, None) for (a, b), n in pairs.items()]
        rows += [(None, None, None, *m) for m in marks]
        yield _frame(rows, _SURVEY)


def _marks(sentence: str, found: list[str], words: _Cache) -> list[tuple]:
    c = _flat([_slot.sub(f" {_MARK} ", sentence)], words)
    at, both, left = _contexts(c)
    here = np.nonzero(c[at] == _MARKED)[0]
    often = bool(_often.search(sentence))
    standing = not often and bool(_standing.search(sentence))
    explains = bool(_explains.search(sentence))
    out = []
    for i, name in zip(here, found, strict=False):
        word_like, blank = bool(_default.match(name)), bool(_blank.match(name))
        alone = (not often and bool(_named.match(name))) or (standing and (word_like or blank))
        out.append((int(both[i] >> np.uint64(1)), int(left[i] >> np.uint64(1)), bool(c[at[i] - 1]), xxhash.xxh64_intdigest(name) >> 1, word_like, blank, explains, alone))
    return out


_APART = "doc_key string, wording long, near int, page int, prior double, context long"


def _second_pass(docs: DataFrame, hubs: np.ndarray, asked: np.ndarray) -> DataFrame:
    """(doc_key, wording, near, page, prior) for every paragraph's wordings that are no hubs, (context) filled by ordinary words, and the numbers of documents and of those without a hub (near, page)."""
    spark = docs.sparkSession
    hub_sent, asked_sent = spark.sparkContext.broadcast(hubs), spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = set(hub_sent.value.tolist()), asked_sent.value
        tokens, words = _Cache(_tail_token), _Cache(_word_codes)
        prior = lru_cache(maxsize=50_000)(_prior)
        for pdf in batches:
            rows: list[tuple] = []
            contexts: set[int] = set()
            n_pages = 0
            for key, text in zip(pdf["doc_key"], pdf["t"], strict=True):
                parts = paragraphs(text)
                tails = [[_wording(s, tokens) for s in part] for part in parts]
                near = [any(w in known for w in part) for part in tails]
                page = not any(near)
                n_pages += page
                for part, found, beside in zip(parts, tails, near, strict=True):
                    once = {w: s for w, s in zip(found, part, strict=True) if w and w not in known}
                    for w, s in once.items():
                        rows.append((key, w, int(beside), int(page), -99.0 if beside else prior(s), None))
                sentences = [s for part in parts for s in part]
                if any(sign in text for sign in _SIGNS):
                    sentences = [_slot.sub(f" {_MARK} ", s) for s in sentences]
                c = _flat(sentences, words)
                at, both, left = _contexts(c)
                plain = c[at] != _MARKED
                asked_here = np.concatenate([both[plain], left[plain]]) >> np.uint64(1)
                contexts.update(asked_here[_passing(asked_here, bits)].tolist())
            rows += [(None, None, None, None, None, x) for x in contexts]
            rows.append((None, None, len(pdf), n_pages, None, None))
            yield _frame(rows, _APART)

    return docs.mapInPandas(run, _APART)


def _prior(sentence: str) -> float:
    """Log odds that a sentence is residue by its words alone: cues shift them, and decide nothing by themselves."""
    words = [w.strip(".,;:!?।").lower() for w in sentence.split()]
    if len(words) > 2 and len({w for w in words if not w.isdigit()}) <= len(words) // 2:
        return REPEATED_ODDS
    return CUE_ODDS if _cue.search(sentence) else PLAIN_ODDS


def hub_wordings(pairs: DataFrame) -> np.ndarray:
    """The wordings that carry running text, from rows (wording, beside, n)."""
    beside = F.when(F.col("beside") != 0, F.col("beside"))
    stats = cut(pairs.filter("wording <> 0").groupBy("wording").agg(F.sum("n").alias("n"), F.approx_count_distinct(beside).alias("company")).withColumns({"wide": F.col("company") >= COMPANY, "size": F.floor(F.log2("n") * 16)}).filter("n > 0"))
    sizes = sorted(((not r["wide"], -r["size"], r["n"]) for r in stats.groupBy("wide", "size").agg(F.sum("n").alias("n")).collect()))  # a row per sixteenth of a power of two
    total, held, last = sum(n for _, _, n in sizes), 0, None
    for narrow, size, n in sizes:
        if held >= RUNNING * total:
            break
        held, last = held + n, (not narrow, -size)
    if last is None:
        return np.zeros(0, dtype=np.int64)
    enough = (F.col("wide") & (F.col("size") >= last[1])) if last[0] else (F.col("wide") | (F.col("size") >= last[1]))
    hubs = stats.filter(enough & (F.col("n") > HUB_SHARE * total)).select("wording").toPandas()
    return np.sort(hubs["wording"].to_numpy(dtype=np.int64))


def page_residue(apart: DataFrame, page_share: float = 0.0) -> DataFrame:
    """(doc_key): documents with error-page, script-notice or filler wordings, from the second pass.

    A wording is residue when its occurrences fit better to residue, which never stands in one paragraph with running
    text and often is all of a document, than to titles, which stand above running text, or to running text itself.
    All documents count, copies of whole pages included; the more occurrences, the surer the verdict, without a step.
    Where documents without any hub are common (``page_share``), being such a document says little.
    """
    per = apart.groupBy("wording").agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("near"), F.sum(F.when(F.col("near") == 0, F.col("page"))).alias("page"), F.max("prior").alias("prior"))
    share = F.least(F.lit(1.0), F.lit(float(ENOUGH)) / F.col("n"))

    def fit(chances: tuple[float, float]) -> Column:
        near, page = chances
        amid = F.col("n") - F.col("near") - F.coalesce("page", F.lit(0))
        return share * (F.col("near") * float(np.log(near)) + F.coalesce("page", F.lit(0)) * float(np.log((1 - near) * page)) + amid * float(np.log((1 - near) * (1 - page))))

    title, prose = (fit((near, max(page, page_share))) for near, page in (TITLE, PROSE))
    most = F.greatest(title, prose)
    other = most + F.log(F.exp(title - most) + F.exp(prose - most))
    wordings = cut(per.select("wording", "n", (F.col("prior") + fit(RESIDUE) - other).alias("odds")).filter("odds > 0"))
    return lookup_join(apart.filter("near = 0").select("doc_key", "wording"), wordings.select("wording", "n"), ["wording"], "inner", counts="n").select("doc_key").distinct()


def slot_residue(marked: DataFrame, filled: DataFrame) -> DataFrame:
    """(doc_key): documents in which a template's slot still holds a variable name, an instruction, a default or a blank.

    All sentences are aligned by the words around a position. Where other texts hold ordinary values between the same
    words, or different variable names stand there, the position is a slot and what stands in it is residue. A name that
    is the only thing ever seen there belongs to the wording (an explanation, a marking such as [sic]) and is no case.
    Wordings that occur in one text only are residue unless the sentence explains a template, and so is a variable name in
    the spelling of a template that recurs without a filling, and a default or blank in the place of a value (STANDING).
    """
    names = cut(marked.groupBy("left").agg(F.count_distinct("name").alias("n_names"), F.count_distinct("fp").alias("n_texts"), F.count(F.lit(1)).alias("n")))
    asked = marked.select(F.explode(F.array("both", "left")).alias("context")).groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    held = cut(asked.join(filled.distinct(), "context", "left_semi"))
    judged = lookup_join(marked, held.select(F.col("context").alias("both"), "n", F.lit(True).alias("fill_both")), ["both"], counts="n")
    judged = lookup_join(judged, held.select(F.col("context").alias("left"), "n", F.lit(True).alias("fill_left")), ["left"], counts="n")
    judged = lookup_join(judged, names, ["left"], counts="n")
    slot = (F.col("fill_both").isNotNull() & (F.col("led") | ~F.col("blank"))) | (~F.col("word_like") & F.col("led") & (F.col("fill_left").isNotNull() | (F.col("n_names") > 1)))
    lone = (F.col("n_texts") == 1) & ~F.col("explains") & ~F.col("word_like") & ~F.col("blank")
    return judged.filter(slot | lone | F.col("alone")).select("doc_key").distinct()


def residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_key): documents with template residue, filler, error-page or script-notice text, each once.

    Null keys and null or empty texts give no row; whole texts are read; repeated texts count once as evidence for slots
    and each for pages, and every document that has the text comes out; an empty table gives none. Further columns are ignored.
    """
    kind = docs.schema[key].dataType
    read = docs.select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("t")).filter("doc_key is not null and t is not null")
    survey = cut(read.mapInPandas(_survey, _SURVEY))
    marked = survey.filter("doc_key is not null").drop("wording", "beside", "n")
    asked = hash_filter(cut(marked.select(F.explode(F.array("both", "left")).alias("hash")).distinct()))
    second = cut(_second_pass(read, hub_wordings(survey.filter("wording is not null").select("wording", "beside", "n")), asked))
    n_docs, n_pages = second.filter("doc_key is null and context is null").agg(F.sum("near"), F.sum("page")).first()
    pages = page_residue(second.filter("doc_key is not null").drop("context"), (n_pages or 0) / (n_docs or 1))
    slots = slot_residue(marked, second.filter("context is not null").select("context"))
    return pages.unionByName(slots).distinct().select(F.col("doc_key").cast(kind).alias("doc_key"))
