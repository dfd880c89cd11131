"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of queries.
STOP_WORDS = (
    "the how does what is where when why this that are can work for with from into about which "
    "their there will would should could have been some just only also did not but and or all any "
    "use used using our my we do if has had was were get got make made way"
).split()
#: Endings and what replaces them, in this order.
ENDINGS = (("ies", "y"), ("ied", "y"), ("ing", ""), ("tion", ""), ("ment", ""), ("ness", ""), ("able", ""), ("ible", ""), ("ful", ""), ("ous", ""))
#: Intents of a question, first match wins: pattern, intent, layer.
INTENTS = (
    (r"\b(business rule|business policy)\b", "knowledge_lookup", "L5"),
    (r"\b(impact of changing|affects which|what repos)\b", "knowledge_impact", "L5"),
    (r"\b(requirement|epic)\b", "knowledge_lookup", "L5"),
    (r"\bpolicy\b", "knowledge_lookup", "L5"),
    (r"\b(where is|defined|find definition|definition of)\b", "definition_lookup", "L1"),
    (r"\b(calls|callers|callees|who calls|invokes)\b", "call_graph", "L1"),
    (r"\b(impact|breaks|what if i change|blast radius)\b", "impact_analysis", "L1"),
    (r"\b(how does|how do|flow|process|works?)\b", "feature_understanding", "L2"),
    (r"\b(pattern|architecture|design)\b", "architecture", "L2"),
    (r"\b(navigate|where do i start|guide|onboard)\b", "module_navigation", "L3"),
    (r"\b(gotcha|trap|non-obvious|watch out|pitfall)\b", "non_obvious_gotchas", "L3"),
    (r"\b(why did|decision|chose|rationale)\b", "past_decisions", "L4"),
    (r"\b(mistake|error|wrong|forgot|bug we hit)\b", "common_mistakes", "L4"),
)
#: Patterns of secrets, applied in this order whatever the case.
SECRETS = (
    r"(?:api[_-]?key|secret|token|password|credential|auth)[\s]*[=:]\s*[\"']?[A-Za-z0-9_\-/.+]{20,}[\"']?",
    r"Bearer\s+[A-Za-z0-9._\-+/=]{20,}",
    r"sk-proj-[A-Za-z0-9\-_]{20,}",
    r"(?:sk|pk|rk|ak)-[A-Za-z0-9][A-Za-z0-9\-_]{19,}",
    r"sk-ant-[A-Za-z0-9\-_]{20,}",
    r"gh[pus]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"xoxb-[A-Za-z0-9\-]+",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9\-_]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"npm_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9\-_]{20,}",
    r"dop_v1_[A-Za-z0-9]{64}",
)
#: What a text must hold, in lower case, for the pattern at the same place to match.
SECRET_MARKS = (
    ("key", "secret", "token", "password", "credential", "auth"), ("bearer",), ("sk-proj-",), ("sk-", "pk-", "rk-", "ak-"), ("sk-ant-",), ("ghp_", "ghu_", "ghs_"), ("github_pat_",),
    ("xoxb-",), ("akia",), ("aiza",), ("eyj",), ("npm_",), ("glpat-",), ("dop_v1_",),
)
#: Endings of file references.
FILE_EXTENSIONS = (".py", ".kt", ".java", ".ts", ".tsx", ".js", ".go", ".swift", ".dart", ".m", ".md")


def tokens(text: Column, min_len: int = 3, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct lower-case ASCII tokens in order of their first place, without stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= min_len) & ~w.isin(*stop)))


def stem(token: Column) -> Column:
    """A token without a common ending, empty if none can go; keeps three characters."""
    out = None
    for ending, new in ENDINGS:
        cut = F.concat(F.substr(token, F.lit(1), F.char_length(token) - len(ending)), F.lit(new))
        rule = (F.endswith(token, F.lit(ending)) & (F.char_length(token) - len(ending) + len(new) >= 3), cut)
        out = F.when(*rule) if out is None else out.when(*rule)
    for ending, more in (("es", 5), ("s", 4), ("ed", 5)):
        out = out.when(F.endswith(token, F.lit(ending)) & (F.char_length(token) > more), F.substr(token, F.lit(1), F.char_length(token) - len(ending)))
    return out.otherwise("")


def slug(text: Column, length: int = 60) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(length))


def count_of(text: Column, part: Column) -> Column:
    """How often a non-empty part lies in a text, without overlaps."""
    return F.when(F.char_length(part) > 0, ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int")).otherwise(0)


def redact(text: Column) -> Column:
    """Private spans and secrets replaced, one pattern after the other.

    A pattern runs only over texts that hold one of its marks, as few do: a search for a
    short string costs a fraction of a regular expression's walk.
    """

    def where_marked(text: Column, marks: tuple[str, ...], replaced: Callable[[Column], Column]) -> Column:
        low = F.lower(text)
        some = F.lit(False)
        for m in marks:
            some = some | F.contains(low, F.lit(m))
        return F.when(some, replaced(text)).otherwise(text)

    out = where_marked(text, ("<private>",), lambda x: F.regexp_replace(x, r"(?i)<private>[\s\S]*?</private>", "[REDACTED]"))

    def one(pattern: str, marks: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda x: where_marked(x, marks, lambda y: F.regexp_replace(y, "(?i)" + pattern, "[REDACTED_SECRET]"))

    def every(x: Column) -> Column:
        for pattern, marks in zip(SECRETS, SECRET_MARKS):
            x = F.transform(F.array(x), one(pattern, marks))[0]  # a one-element array binds each step's text
        return x

    # a redaction adds none of the marks but "secret", whose pattern comes first
    return F.transform(F.array(out), lambda x: where_marked(x, tuple(dict.fromkeys(m for marks in SECRET_MARKS for m in marks)), every))[0]


def intent(question: Column) -> Column:
    """struct(intent, layer) of the first pattern that matches."""
    q, out = F.lower(question), None
    for pattern, name, layer in INTENTS:
        value = F.struct(F.lit(name).alias("intent"), F.lit(layer).alias("layer"))
        out = F.when(q.rlike(pattern), value) if out is None else out.when(q.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit("complex").alias("intent"), F.lit("ALL").alias("layer")))


#: How a command, not a file, begins.
COMMANDS = ("./", "grafwerk ")


def backtick_refs(body: Column) -> Column:
    """Every span in back ticks, over lines too, as often as it stands there."""
    return F.regexp_extract_all(body, F.lit("`([^`]+)`"), F.lit(1))


def _pathlike(ref: Column) -> Column:
    ending = F.contains(ref, F.lit("/"))
    for e in FILE_EXTENSIONS:
        ending = ending | F.endswith(ref, F.lit(e))
    return ending


def is_file_ref(ref: Column) -> Column:
    command = F.lit(False)
    for c in COMMANDS:
        command = command | F.startswith(ref, F.lit(c))
    return _pathlike(ref) & ~command


def is_symbol_ref(ref: Column) -> Column:
    return ref.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\(\))?$") & ~_pathlike(ref)


def truncate_result(text: Column, limit: int = 60_000) -> Column:
    """At most ``limit`` characters, cut after the last whole line if there is one."""
    head = F.left(text, F.lit(limit))
    line = F.regexp_replace(head, r"\n[^\n]*\z", "")  # $ would also stop before a last line break
    return F.when(F.char_length(text) <= limit, text).otherwise(line)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def query_terms(pattern: str) -> list[str]:
    """Terms of a symbol search: wild cards off, split where neither letter nor digit."""
    return [t for t in re.split(r"[^A-Za-z0-9]+", pattern.strip("*%")) if t]


def is_prefix_pattern(pattern: str) -> bool:
    """Only a word and then wild cards."""
    return re.fullmatch(r"[A-Za-z0-9]+[*%]+", pattern) is not None
