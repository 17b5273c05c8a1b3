"""Text functions as column expressions; where a rule needs a loop over words, an Arrow-batched UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BRACKETS = {"(": (r"\(", r"\)"), "[": (r"\[", r"\]"), "<": ("<", ">")}
STOPWORDS = tuple("a an and are as at be been by for from had has have in into is it its of on or that the their this to was were which with".split())
PREPOSITIONS = frozenset("about above across after against along among around at before behind below between by during for from in into near of off on onto out over per since through to toward towards under until up upon via with within without who which that".split())
#: Kind names with an ordinary -s that are no plurals.
_NO_PLURAL = re.compile(r"(ss|us|is|ics|ous|news|series|species)$")
_IRREGULAR = {"people": "person", "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "alumni": "alumnus", "media": "medium", "criteria": "criterion", "phenomena": "phenomenon"}


def capitalize(c: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def regular_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def interleave(a: Column, b: Column) -> Column:
    """a1 b1 a2 b2 ... of two arrays as one string."""
    return F.array_join(F.zip_with(a, b, lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))), "")


def token_label(tokens: Column, spaces: Column) -> Column:
    """Tokens and the spaces after them as a label, without spaces ahead and ' ,(' behind."""
    return F.regexp_replace(F.ltrim(interleave(tokens, spaces)), r"[ ,(]+$", "")


def transfer_casing(source: Column, target: Column) -> Column:
    """``target`` with the upper and lower case of ``source`` position by position; beyond its end the case of its last letter."""
    at = F.sequence(F.lit(1), F.greatest(F.length(target), F.lit(1)))
    one = lambda i: source.substr(F.least(i, F.length(source)), F.lit(1))
    cased = F.transform(at, lambda i: F.when(one(i) == F.upper(one(i)), F.upper(target.substr(i, F.lit(1)))).otherwise(F.lower(target.substr(i, F.lit(1)))))
    return F.when((F.length(source) == 0) | (F.length(target) == 0), target).otherwise(F.array_join(cased, ""))


def normal_separators(c: Column) -> Column:
    return F.translate(c, "-", "_")


def alphanumeric(c: Column) -> Column:
    """Letters, digits and spaces only; a text that this leaves 2 characters or fewer stays as it was."""
    plain = regular_spaces(F.regexp_replace(c, r"[^A-Za-z0-9 ]", ""))
    return F.when(F.length(plain) > 2, plain).otherwise(c)


def remove_brackets(c: Column, kind: str = "(", substitute: str = " ") -> Column:
    """Innermost bracketed parts and the spaces around them become ``substitute``; trimmed."""
    a, b = _BRACKETS[kind]
    return F.trim(F.regexp_replace(c, rf"\s*{a}[^{a}{b}]*{b}\s*", substitute))


#: Endings of labels that list alphabetically or by range.
LABEL_ENDINGS = (
    r"\s*\([^()]*\)$", r"\s*/\s*[A-Z](?:\s*[-–]\s*[A-Z])?$", r"\s*:\s*[A-Z](?:\s*[-–]\s*[A-Z])?$", r"\s*,\s*[A-Z](?:\s*[-–]\s*[A-Z])?$",
    r"\s+[-–]\s+[A-Z](?:\s*[-–]\s*[A-Z])?$", r"\s*\(?[0-9]{1,4}\s*[-–]\s*[0-9]{1,4}\)?$", r"\s*:\s*[0-9]{1,4}$", r"\s+[A-Z]\s*[-–]\s*[A-Z]$",
)


def drop_endings(c: Column) -> Column:
    for pattern in LABEL_ENDINGS:
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def fold(c: Column) -> Column:
    """Accents off, by canonical decomposition; letters without one stay."""
    return _fold(c)


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(k for k in unicodedata.normalize("NFKD", x) if not unicodedata.combining(k)))


def label_tokens(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Sorted distinct lower-case words of a label without accents, signs and stop words; all its words where it has only stop words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), fold(c)).otherwise(c)), "[^a-z0-9 ]", " "), r"\s+"), lambda w: w != "")
    kept = F.array_except(words, F.array(*map(F.lit, stopwords)))
    return F.array_sort(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(words)))


def name_to_label(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def label_to_name(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def canonical_iri(c: Column) -> Column:
    """Without a '__' fragment."""
    return F.substring_index(c, "__", 1)


def iri_to_name(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def name_to_iri(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), c)


def resource_label(name: Column, label: Column, prefix: str = "", list_page: bool = False) -> Column:
    """The label, else the name in words, without a prefix; a list page's label also loses 'the '."""
    out = F.coalesce(label, name_to_label(name))
    out = F.regexp_replace(out, f"^{re.escape(prefix)}", "") if prefix else out
    return F.regexp_replace(out, "^the ", "") if list_page else out


def same_words(a: Column, b: Column) -> Column:
    """Whether two phrases have the same set of words."""
    words = lambda c: F.array_sort(F.array_distinct(F.split(F.lower(c), " ")))
    return words(a) == words(b)


def valid_label(c: Column) -> Column:
    """Longer than two characters and not digits alone."""
    return (F.length(c) > 2) & ~c.rlike("^[0-9]+$")


# ---- word rules ----------------------------------------------------------------------------------------------------------------


def is_plural(word: str) -> bool:
    w = word.lower()
    return w in _IRREGULAR or (len(w) > 2 and w.endswith("s") and not _NO_PLURAL.search(w))


def singular(word: str) -> str:
    """An English plural's singular; the case of what stays is kept."""
    w = word.lower()
    if w in _IRREGULAR:
        s = _IRREGULAR[w]
        return s.capitalize() if word[:1].isupper() else s
    if not is_plural(word):
        return word
    for end, new in (("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("zzes", "zz"), ("oes", "o"), ("ives", "ife"), ("lves", "lf")):
        if w.endswith(end) and len(w) > len(end) + 1:
            return word[: len(word) - len(end)] + new
    return word[:-1]


def lemma(word: str) -> str:
    return singular(word.lower())


_BY_END = ("in", "from", "of", "at", "during", "since", "until")
_BY_NOT = ("by-", "bye", "near")


def split_by_phrase(text: str) -> tuple[str, str]:
    """(what stays, what goes) of a label: the part from ' by ' goes, but a later ' in ...' or ' from ...' stays.

    Nothing goes where 'by' opens the label, follows a participle with a capitalised agent ('written by Anna'), or precedes the last of a date or a number.
    """
    words = text.split(" ")
    for i, w in enumerate(words):
        if w != "by" or i == 0 or i == len(words) - 1:
            continue
        before, after = words[i - 1].lower(), words[i + 1]
        if (before.endswith(("ed", "en", "wn", "ung", "ught", "ound", "uilt")) and after[:1].isupper()) or after[:1].isdigit() or before in PREPOSITIONS:
            continue
        rest = words[i + 1 :]
        keep = next((j for j, x in enumerate(rest) if j and x in ("in", "from")), len(rest))
        return " ".join(words[:i] + rest[keep:]), " ".join(["by", *rest[:keep]])
    return text, ""


def head_parts(label: str) -> tuple[list[str], list[str], list[str], str, bool]:
    """(subjects, head, remainder, other, plural) of a label.

    The head phrase is what precedes the first preposition, relative word or comma; its subjects are its last word and the words that
    'and'/'or' join to it; the remainder are its other lemmas; other is the text outside it, after by-phrase removal.
    """
    text, _ = split_by_phrase(label)
    words = [w for w in re.split(r"\s+", text.strip()) if w]
    stop = next((i for i, w in enumerate(words) if i and (w.lower() in PREPOSITIONS or words[i - 1].endswith(","))), len(words))
    if words and words[0][:1].isdigit() and stop == 1 and len(words) > 1:  # a number alone is no head
        stop = next((i for i, w in enumerate(words) if i > 1 and w.lower() in PREPOSITIONS), len(words))
    head = [w.strip(",;:.()") for w in words[:stop]]
    head = [w for w in head if w]
    if not head:
        return [], [], [], text, False
    subjects = [head[-1]]
    at = len(head) - 1
    while at >= 2 and head[at - 1].lower() in ("and", "or"):
        subjects.insert(0, head[at - 2])
        at -= 2
    lemmas = [lemma(s) for s in subjects]
    rest = sorted({lemma(w) for w in head[:at] if w not in subjects and w.lower() not in ("and", "or", "the", "a", "an")} - set(lemmas))
    return lemmas, [lemma(w) for w in head], rest, " ".join(words[stop:]).lower(), all(map(is_plural, subjects))


_WORDS = T.ArrayType(T.StringType())
_HEAD = T.StructType([T.StructField("subjects", _WORDS), T.StructField("head", _WORDS), T.StructField("rest", _WORDS), T.StructField("other", T.StringType()), T.StructField("plural", T.BooleanType())])


@F.pandas_udf(_HEAD)
def lexical_head(labels: pd.Series) -> pd.DataFrame:
    """Head structure of labels, one evaluation a distinct label of the batch; null labels have empty ones."""
    known: dict[str, tuple] = {}
    rows = []
    for x in labels:
        x = x or ""
        if x not in known:
            known[x] = head_parts(x)
        rows.append(known[x])
    return pd.DataFrame(rows, columns=["subjects", "head", "rest", "other", "plural"])


@F.pandas_udf(T.StringType())
def remove_by_phrase(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: None if x is None else split_by_phrase(x)[0])


def canonical_label(c: Column) -> Column:
    """Without by-phrase and without alphabetical or range endings."""
    return drop_endings(F.when(c.contains(" by "), remove_by_phrase(c)).otherwise(c))


@F.pandas_udf(T.StringType())
def singularize(labels: pd.Series) -> pd.Series:
    """A phrase with its head words in the singular; 'and' between plural heads becomes 'or'."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        words = x.split(" ")
        stop = next((i for i, w in enumerate(words) if i and w.lower() in PREPOSITIONS), len(words))
        out, heads = list(words), [stop - 1]
        while heads[0] >= 2 and words[heads[0] - 1] in ("and", "or"):
            heads.insert(0, heads[0] - 2)
        plural = [is_plural(words[h]) for h in heads]
        for h, p in zip(heads, plural, strict=True):
            if p:
                out[h] = singular(words[h])
        for h, p in zip(heads[:-1], plural, strict=False):
            if p and words[h + 1] == "and":
                out[h + 1] = "or"
        return " ".join(out)

    return labels.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def content_lemmas(labels: pd.Series) -> pd.Series:
    """Sorted lemmas of a label's words that are no stop words."""
    return labels.map(lambda x: sorted({lemma(w) for w in re.findall(r"[\w'-]+", x or "") if w.lower() not in STOPWORDS}))


#: Hearst patterns: (words between, whether the kind stands left).
HEARST = (
    (r"(?:am|is|are|was|were|be|been|being) an?", False), ("(?:and|or) other", False), ("including", True), ("such as", True), ("especially", True), ("particularly", True), ("other than", True),
)
_WORD = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"
#: Words that no noun chunk of a Hearst pair holds, and those that may open one.
NO_NOUNS = "|".join(sorted({*STOPWORDS, *PREPOSITIONS, "and", "or", "but", "other", "such", "including", "especially", "particularly", "am", "be", "been", "being", "he", "she", "they", "we", "you", "i"}))
OPENERS = "the|a|an|this|that|these|those|his|her|its|their|some|any|all|many|most"
#: Characters beside a pattern in which its chunks of up to four words are looked for.
BESIDE = 160


def chunk_before(c: Column) -> Column:
    """The words without function words that ``c`` ends with, four at most and single-spaced; null where it ends with anything else."""
    tail = F.regexp_replace(F.regexp_extract(F.right(c, F.lit(BESIDE)), rf"((?:{_WORD}\s+){{0,3}}{_WORD})\z", 1), r"\s+", " ")
    kept = F.regexp_replace(F.concat(F.lit(" "), tail), rf"^.* (?:{NO_NOUNS}) ", " ")
    return F.when((tail != "") & ~tail.rlike(rf"(?:^| )(?:{NO_NOUNS})\z"), F.trim(kept))


def chunk_after(c: Column) -> Column:
    """The words without function words that ``c`` begins with after an article, four at most; null where it begins with anything else."""
    head = F.regexp_replace(F.regexp_extract(F.left(c, F.lit(BESIDE)), rf"^((?:{_WORD}\s+){{0,3}}{_WORD})", 1), r"\s+", " ")
    opened = F.regexp_replace(head, rf"^(?:{OPENERS}) ", "")
    kept = F.regexp_extract(opened, rf"^(.*?)(?: (?:{NO_NOUNS})(?: .*)?)?\z", 1)
    return F.when((opened != "") & ~opened.rlike(rf"^(?:{NO_NOUNS})(?: |\z)"), kept)


def hearst_pairs(c: Column) -> Column:
    """(hypo, hyper) lower-case noun chunks beside each Hearst pattern of a text, whole texts, by expressions alone; null texts have none.

    A chunk is a run of words that are no function words, right before or after the pattern; any other sign in between makes no pair.
    """
    text = F.lower(F.coalesce(c, F.lit("")))
    found = []
    for words, left in HEARST:
        parts = F.split(text, rf"\s+{words}\s+".replace(" ", r"\s+"))
        before = F.transform(F.slice(parts, 1, F.size(parts) - 1), chunk_before)
        after = F.transform(F.slice(parts, 2, F.size(parts)), chunk_after)
        hypo, hyper = (after, before) if left else (before, after)
        found.append(F.zip_with(hypo, hyper, lambda o, e: F.struct(o.alias("hypo"), e.alias("hyper"))))
    return F.filter(F.concat(*found), lambda p: p.hypo.isNotNull() & p.hyper.isNotNull() & (p.hypo != p.hyper))


# ---- words by tables -----------------------------------------------------------------------------------------------------------


def iri_kind(iri: Column, base: str) -> Column:
    """category, file, list or resource for IRIs of ``base``'s resources, class for those of its ontology; null for others."""
    name = iri_to_name(iri, base + "resource/")
    return (
        F.when(iri.startswith(base + "ontology/"), "class")
        .when(~iri.startswith(base + "resource/"), None)
        .when(name.startswith("Category:"), "category").when(name.startswith("File:") | name.startswith("Image:"), "file")
        .when(name.startswith("List_of_") | name.startswith("Lists_of_"), "list").otherwise("resource")
    )
