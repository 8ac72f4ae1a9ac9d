"""String functions over columns: package names, API paths, token sets, answers and model outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alias of a package or two-part path -> package.
PACKAGE_ALIASES = {
    "np": "numpy",
    "pd": "pandas",
    "plt": "matplotlib",
    "mpl": "matplotlib",
    "sk": "sklearn",
    "sklearn": "scikit-learn",
    "tf": "tensorflow",
    "torch": "torch",
    "cv2": "opencv-python",
    "scipy.stats": "scipy",
    "scipy.optimize": "scipy",
    "scipy.linalg": "scipy",
    "matplotlib.pyplot": "matplotlib",
    "matplotlib.axes": "matplotlib",
    "seaborn": "sns",
}
#: Distribution name -> normal name.
PACKAGE_SYNONYMS = {
    "scikit-learn": "sklearn",
    "opencv-python": "cv2",
    "pillow": "pil",
    "beautifulsoup4": "bs4",
    "python-dateutil": "dateutil",
    "pytorch": "torch",
}
#: Equivalent API prefixes, and a part replaced everywhere.
PATH_PREFIXES = (("scipy.fftpack", "scipy.fft"), ("matplotlib.axes._axes", "matplotlib.axes"))
PATH_PARTS = (("pylab", "pyplot"),)
#: Warnings that tell a deprecated call.
DEPRECATION_KEYWORDS = ("DeprecationWarning", "FutureWarning", "PendingDeprecationWarning", "deprecate")
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FENCES = ("```python", "```")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def squeeze(text: Column) -> Column:
    """Text without white space at its ends (ASCII kinds)."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def strip_version_operator(version: Column) -> Column:
    """Leading >=, <=, == removed, each once and in that order."""
    return reduce(lambda c, op: F.when(F.startswith(c, F.lit(op)), F.substring(c, 3, 1 << 30)).otherwise(c), (">=", "<=", "=="), version)


def api_package(path: Column, use_aliases: bool = True, compat: bool = False) -> Column:
    """Package of a dotted API path: alias of its first two parts, else (if wanted) of the first, else the first part; blanks around and case don't count.

    ``compat=True`` keeps the alias of ``seaborn``, which makes it differ from the package's own name.
    """
    table = PACKAGE_ALIASES if compat else {k: v for k, v in PACKAGE_ALIASES.items() if k != "seaborn"}
    parts = F.split(F.lower(F.trim(path)), r"\.")
    first = F.element_at(parts, 1)
    two = F.when(F.size(parts) >= 2, F.try_element_at(_lookup(table), F.concat_ws(".", first, F.element_at(parts, 2))))
    one = F.try_element_at(_lookup(table), first) if use_aliases else F.lit(None)
    return F.coalesce(two, one, first)


def normalize_package(name: Column) -> Column:
    """Lower case, no blanks around, six synonyms resolved."""
    low = squeeze(F.lower(name))
    return F.coalesce(F.try_element_at(_lookup(PACKAGE_SYNONYMS), low), low)


def normalize_api_path(path: Column) -> Column:
    """The first matching prefix rule, then part rules everywhere."""
    out = path
    for old, new in reversed(PATH_PREFIXES):
        out = F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(out)
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), PATH_PARTS, out)


def map_corpus_path(path: Column) -> Column:
    """The same rules, replaced wherever they occur."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), (*PATH_PREFIXES, *PATH_PARTS), path)


def token_set(text: Column) -> Column:
    """Distinct lower-case identifiers of more than one character."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def overlap_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token sets, plus 0.3 if one holds the other, at most 1; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    jaccard = common / (F.size(a) + F.size(b) - common)
    bonus = F.when(common == F.least(F.size(a), F.size(b)), 0.3).otherwise(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), jaccard + bonus))


def first_sentence(text: Column) -> Column:
    return F.split_part(text, F.lit("."), F.lit(1))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return F.array_join(words(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")), " ")


#: Fixed value: full-width punctuation.
ZH_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏"


def normalize_zh_answer(text: Column, punctuation: str = ZH_PUNCTUATION) -> Column:
    """Lower case, neither ASCII nor full-width punctuation, no white space."""
    return F.regexp_replace(F.translate(F.lower(text), PUNCTUATION + punctuation, ""), r"\s+", "")


def number_score(prediction: Column, truth: Column) -> Column:
    """Share of the prediction's numbers that equal the truth; 0 without numbers."""
    numbers = F.regexp_extract_all(prediction, F.lit(r"[0-9]+"), F.lit(0))
    right = F.size(F.filter(numbers, lambda n: n == truth))
    return F.when(F.size(numbers) == 0, 0.0).otherwise(right / F.size(numbers))


def paragraph_id(truth: Column, word: str = "Paragraph ") -> Column:
    """The first paragraph number named; null if there is none."""
    return F.nullif(F.regexp_extract(truth, word + r"([0-9]+)", 1), F.lit(""))


def normalize_scientific(text: Column) -> Column:
    """1.0E-06 -> 1e-6; other texts stay."""
    pattern = r"^([-+]?[0-9]*\.?[0-9]+)[eE]([-+]?[0-9]+)$"
    bare = squeeze(text)
    coefficient = F.regexp_extract(bare, pattern, 1)
    cut = F.when(F.contains(coefficient, F.lit(".")), F.regexp_replace(F.regexp_replace(coefficient, "0+$", ""), r"\.$", "")).otherwise(coefficient)
    exponent = F.regexp_extract(bare, pattern, 2).try_cast("int").cast("string")
    return F.when(F.regexp_like(bare, F.lit(pattern)), F.concat(cut, F.lit("e"), exponent)).otherwise(text)


def _after(text: Column, mark: str) -> Column:
    return F.substr(text, F.instr(text, mark) + F.lit(len(mark)))


def _before(text: Column, mark: str) -> Column:
    """Up to the mark, or all."""
    return F.when(F.contains(text, F.lit(mark)), F.substr(text, F.lit(1), F.instr(text, mark) - 1)).otherwise(text)


def _unfenced(text: Column) -> Column:
    return reduce(lambda c, fence: F.replace(c, F.lit(fence), F.lit("")), FENCES, text)


def _between(text: Column, ends: tuple[str, ...]) -> Column:
    """After <start> and before the first kind of end that occurs anywhere; without <start> the whole.  Fences go.

    An end before the start leaves nothing, as slicing would.
    """
    start = F.instr(text, "<start>") + F.lit(len("<start>"))
    part = F.substr(text, start)
    for end in reversed(ends):
        to = F.instr(text, end)
        part = F.when(F.contains(text, F.lit(end)), F.substr(text, start, F.greatest(F.lit(0), to - start))).otherwise(part)
    return _unfenced(F.when(F.contains(text, F.lit("<start>")), part).otherwise(text))


def clean_basic(text: Column) -> Column:
    return _between(text, ("<end>",))


def clean_loose(text: Column) -> Column:
    return _between(text, ("<end>", "</end>"))


# The marks after "###" below are fixed values: headings that models' outputs have.


def clean_lora(text: Column) -> Column:
    return _before(_before(clean_basic(text), "### Refactored new code"), "### Explanation")


def clean_review(text: Column) -> Column:
    """As reviewers' outputs are cleaned, with the result given back."""
    return clean_basic(_before(text, "### new version code after revision"))


def clean_errorfix(text: Column) -> Column:
    return clean_basic(_before(text, "###"))


def clean_wrapper_first(text: Column) -> Column:
    """The first ```python block, else as the loose cleaner."""
    inside = squeeze(_before(_after(text, "```python"), "```"))
    return F.when(F.contains(text, F.lit("```python")), inside).otherwise(clean_loose(text))


def clean_final_code(text: Column) -> Column:
    """Between <finalcode> and </finalcode> (to the end without it), else the first fenced block, else the text."""
    inside = squeeze(_unfenced(_before(_after(text, "<finalcode>"), "</finalcode>")))
    return F.when(F.contains(text, F.lit("<finalcode>")), inside).otherwise(clean_wrapper_first(text))


#: Cleaners by name.
CLEANERS = {
    "basic": clean_basic,
    "loose": clean_loose,
    "lora": clean_lora,
    "review": clean_review,
    "errorfix": clean_errorfix,
    "py_wrapper_first": clean_wrapper_first,
    "finalcode": clean_final_code,
}


def cleaner(name: str):
    if name not in CLEANERS:
        raise ValueError(f"unknown cleaner: {name}")
    return CLEANERS[name]


def mentions_deprecation(text: Column, keywords: tuple[str, ...] = DEPRECATION_KEYWORDS) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords])


def stop_word_at_end(text: Column, stops: tuple[str, ...], tail: int = 15) -> Column:
    end = F.right(text, F.lit(tail))
    return reduce(lambda a, b: a | b, [F.contains(end, F.lit(s)) for s in stops])


def normalize_indentation(code: Column) -> Column:
    """The first non-blank line's indent taken off each line that begins with it: a line feed and the indent become a line feed."""
    blank = F.regexp_extract(code, r"^([ \t\n\r\f\x0B]*)[^ \t\n\r\f\x0B]", 1)  # all before the first character that isn't white space
    indent = F.regexp_extract(F.substring_index(blank, "\n", -1), r"^([ \t]*)", 1)
    return F.substr(F.replace(F.concat(F.lit("\n"), code), F.concat(F.lit("\n"), indent), F.lit("\n")), F.lit(2))


def repetitive(text: Column, most: int = 3) -> Column:
    """Whether a sentence (between full stops, blank ones aside) occurs more than ``most`` times."""
    sentences = F.filter(F.transform(F.split(text, r"\."), squeeze), lambda s: s != "")
    return F.exists(F.array_distinct(sentences), lambda s: F.size(F.filter(sentences, lambda x: x == s)) > most)


def strip_markdown(text: Column) -> Column:
    """Fence lines removed, single quotes made double."""
    return F.replace(F.regexp_replace(text, r"(?m)^```[a-z]*[ \t]*$", ""), F.lit("'"), F.lit('"'))


def fix_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",[ \t\n\r]*([}\]])", "$1")
