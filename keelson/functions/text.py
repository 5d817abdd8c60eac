"""Scorers of answers, as column expressions where built-in functions can say it."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What normalisation drops, how answers are announced (tried in this order, case aside), and numbers.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
ARTICLES = ("a", "an", "the")
ANNOUNCED = (
    r"answer(?:\s+is)?\s*[:=]?\s*([0-9]{1,4})",
    r"\\boxed\{([0-9]{1,4})\}",
    r"(?:therefore|thus|so)\s*,?\s*(?:the\s+answer\s+is\s*)?([0-9]{1,4})",
    r"(?:\*\*|__)([0-9]{1,4})(?:\*\*|__)\s*$",
    r"([0-9]{1,4})\s*$",
)
LARGEST = 999
NUMBER = r"-?\d+(?:\.\d+)?"
SIZING = r"\\(left|right|big|Big|bigg|Bigg)\s*"

_BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
_IN_WORD = r"[\p{L}\p{N}_]"


def normalised_answer(text: Column) -> Column:
    """Lower case, then no articles, then no punctuation, then single blanks: ``a-b`` is ``b``."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?<!{_IN_WORD})({'|'.join(ARTICLES)})(?!{_IN_WORD})", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, PUNCTUATION, ""), _BLANK, " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalised_answer(text), " "), lambda x: x != "")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 over token multisets; 0 where nothing is common, two empty texts included."""
    p, g = answer_tokens(prediction), answer_tokens(gold)
    common = F.aggregate(
        F.array_distinct(p),
        F.lit(0),
        lambda a, w: a + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(g, lambda x: x == w))),
    )
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def best_f1(prediction: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(prediction, g))), F.lit(0.0))


def contains_answer(prediction: Column, golds: Column) -> Column:
    """Whether any normalised gold stands in the normalised prediction."""
    return F.exists(golds, lambda g: F.contains(normalised_answer(prediction), normalised_answer(g)))


def substring_share(prediction: Column, references: Column) -> Column:
    """Share of references that stand in the prediction, case aside; 0 without references."""
    found = F.size(F.filter(references, lambda r: F.contains(F.lower(prediction), F.lower(r))))
    return F.when(F.size(references) > 0, found / F.size(references)).otherwise(0.0)


def competition_answer(text: Column) -> Column:
    """A whole number from 0 to LARGEST, as text: the first announcement whose first number fits, else the last number of up to three digits; null if none."""
    t = F.regexp_replace(text, rf"^{_BLANK}|{_BLANK}$", "")
    said = [F.regexp_extract(t, f"(?i){form}", 1) for form in ANNOUNCED]
    fits = [F.when(x != "", F.when(x.cast("int") <= LARGEST, x.cast("int").cast("string"))) for x in said]
    short = F.regexp_extract_all(t, F.lit(rf"(?<!{_IN_WORD})([0-9]{{1,3}})(?!{_IN_WORD})"), F.lit(1))
    return F.coalesce(*fits, F.when(F.size(short) > 0, F.element_at(short, -1)))


def last_number(text: Column) -> Column:
    """The last number of a text, sign and decimals included; null if none."""
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.when(F.size(numbers) > 0, F.element_at(numbers, -1))


def competition_score(text: Column, gold: Column) -> Column:
    """1 where the answer is ``gold``, zeros in front aside."""
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    return F.coalesce((bare(competition_answer(text)) == bare(gold)).cast("double"), F.lit(0.0))


def boxed_of(text: str | None) -> str | None:
    """The content of the last ``\\boxed{...}`` whose braces balance, without blanks around it; else the last number; else null."""
    open_, text = [], text or ""
    found: dict[int, str] = {}
    for m in re.finditer(r"\\boxed\{|[{}]", text):
        if m[0] != "}":
            open_.append((m.start(), m.end(), len(m[0]) > 1))
        elif open_:
            start, inner, boxed = open_.pop()
            if boxed:
                found[start] = text[inner : m.start()].strip()
    if found:
        return found[max(found)]
    numbers = re.findall(NUMBER, text)
    return numbers[-1] if numbers else None


@F.pandas_udf(StringType())
def boxed_answer(texts):  # nested braces are beyond regular expressions
    return texts.map(boxed_of)


def math_form(formula: str | None) -> str | None:
    """A formula without sizing, text commands and blanks, in lower case; a number in its shortest form; nothing is ``0``."""
    if formula is None:
        return None
    t = re.sub(SIZING, "", formula.strip().replace("\u0120", " ")).replace(r"\dfrac", r"\frac")
    t = re.sub(r"\s+", "", re.sub(r"\\text\{([^}]*)\}", r"\1", t)).lower()
    try:
        number = float(t)
    except ValueError:
        return t or "0"
    if not math.isfinite(number):
        return t
    return str(int(number)) if number == int(number) else str(number)


@F.pandas_udf(StringType())
def normalised_math(formulas):  # numbers in their shortest form
    return formulas.map(math_form)


def math_score(text: Column, gold: Column) -> Column:
    """1 where the boxed answer has the form of ``gold``; 0 where there is no answer."""
    return F.coalesce((normalised_math(boxed_answer(text)) == normalised_math(gold)).cast("double"), F.lit(0.0))


#: Tasks scored by token F1; all others by containment of an answer.
F1_TASKS = ("narrativeqa", "qasper", "multifieldqa_en", "hotpotqa", "2wikimqa", "musique", "triviaqa", "samsum")


def task_score(task: Column, prediction: Column, golds: Column) -> Column:
    """The metric of a row's task: the best token F1 over the answers, or whether any of them stands in the prediction."""
    return F.when(task.isin(*F1_TASKS), best_f1(prediction, golds)).otherwise(contains_answer(prediction, golds).cast("double"))
