"""Parser of languages with braces: tokens first, then declarations by their own grammar.

A file becomes tokens (comments and strings set aside, lines kept), brackets are matched once,
and a walk over statement starts recognises types, functions, fields and imports of Java,
Kotlin, TypeScript, JavaScript, Go, Swift, Dart and Objective-C. Signatures may span lines and
nest generics. Calls are read inside bodies; a receiver's type comes from declared fields,
parameters and locals, from ``this`` and from constructor calls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|[ \t\r\f]+)|(?P<line>\n)|(?P<text>\"{3}.*?(?:\"{3}|\Z)|@?"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<mark>\#import|[@\#]?[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>->|=>|\?\.|::|&&|\|\||[^\s])""",
    re.S | re.X,
)
_PAIR = {"(": ")", "[": "]", "{": "}"}

TYPES = {
    "java": {"class": "class", "record": "class", "interface": "interface", "enum": "enum"},
    "kotlin": {"class": "class", "object": "class", "interface": "interface"},
    "typescript": {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace"},
    "go": {},
    "swift": {"class": "class", "struct": "class", "actor": "class", "extension": "class", "protocol": "interface", "enum": "enum"},
    "dart": {"class": "class", "mixin": "mixin", "enum": "enum", "extension": "extension"},
    "objc": {},
}
MODIFIERS = frozenset("public private protected internal static final abstract open override export default async suspend inline sealed data inner lateinit readonly declare fileprivate mutating synchronized native transient volatile operator infix tailrec external const late covariant required convenience weak lazy companion annotation value expect actual".split())
NO_CALL = frozenset("if for while switch catch return function fun func class new super this when else do try sizeof typeof await throw guard where case in is as assert yield with constructor init self synchronized using".split())
GO_WORDS = frozenset("go defer select range make chan".split())
#: Languages whose qualified names begin with the name of the file.
FILE_SCOPED = ("typescript", "dart", "objc")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    end: int
    fresh: bool  #: first on its line


@dataclass
class Scope:
    name: str
    kind: str
    symbol: dict | None
    types: dict[str, str] = field(default_factory=dict)


def tokens(text: str) -> list[Token]:
    out, line, fresh = [], 1, True
    for m in _TOKEN.finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind == "line":
            line, fresh = line + 1, True
            continue
        breaks = word.count("\n")
        if kind != "skip":
            out.append(Token(kind, word, line, line + breaks, fresh))
            fresh = False
        line += breaks
    return out


class Reader:
    def __init__(self, text: str, language: str, stem: str = "") -> None:
        self.language = "typescript" if language == "javascript" else language
        self.t = tokens(text)
        self.close = self._matched()
        self.symbols: list[dict] = []
        self.edges: list[dict] = []
        self.imports: list[dict] = []
        self.scopes: list[Scope] = []
        self.prefix = [stem] if stem and self.language in FILE_SCOPED else []

    def _matched(self) -> dict[int, int]:
        """Index of the bracket that closes each opening one; an unclosed one ends the file."""
        found, open_ = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "sign" and t.text in _PAIR:
                open_.append(i)
            elif t.kind == "sign" and t.text in _PAIR.values():
                while open_:
                    j = open_.pop()
                    found[j] = i
                    if _PAIR[self.t[j].text] == t.text:
                        break
        return found | dict.fromkeys(open_, len(self.t) - 1)

    # --- small steps ------------------------------------------------------------------
    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "mark" and self.t[i].text[0] not in "@#"

    def after(self, i: int) -> int:
        """Past a token and, if it opens a bracket, all that this holds."""
        return self.close.get(i, i) + 1

    def generics(self, i: int) -> int:
        """Past type arguments that begin here, if they do."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t) and self.at(j) not in ("{", ";"):
            depth += (self.at(j) == "<") - (self.at(j) == ">")
            j = self.after(j)
            if not depth:
                return j
        return i

    def kind(self, i: int) -> tuple[str, int]:
        """The last name of a type that begins here, and what comes after it."""
        name, j = "", i
        while self.word(j) or self.at(j) in ("*", "&", "?"):
            if self.word(j):
                name = self.at(j)
            j += 1
            if self.at(j) != "." and not (self.at(j - 1) in ("*", "&", "?") and self.word(j)):
                break
            j += self.at(j) == "."
        j = self.generics(j)
        while self.at(j) in ("?", "*", "!") or self.at(j) == "[" and self.at(j + 1) == "]":
            j = self.after(j)
        return name, j

    def define(self, name: str, kind: str, first: int, last: int, modifiers: list[str] = (), keep: bool = True) -> Scope:
        scope = [*self.prefix, *(s.name for s in self.scopes if s.name), name]
        symbol = {"name": name, "qualified_name": ".".join(scope), "kind": kind, "line_start": self.t[first].line, "line_end": self.t[min(last, len(self.t) - 1)].end, "docstring": None, "modifiers": list(modifiers)}
        if keep:
            self.symbols.append(symbol)
        return Scope(name, kind, symbol)

    def edge(self, owner: str | None, target: str, kind: str, line: int, receiver: str | None = None) -> None:
        self.edges.append({"owner": owner, "target_name": target, "kind": kind, "line": line, "receiver_type": receiver})

    def owner(self) -> str | None:
        return next((s.symbol["qualified_name"] for s in reversed(self.scopes) if s.symbol), None)

    def inside(self) -> Scope | None:
        return next((s for s in reversed(self.scopes) if s.kind in ("class", "interface", "enum", "mixin", "extension", "protocol", "category")), None)

    # --- the walk ---------------------------------------------------------------------
    def read(self) -> Reader:
        self.body(0, len(self.t), False)
        return self

    def body(self, i: int, end: int, calls: bool) -> None:
        """Statements up to ``end``; ``calls`` in the body of a function."""
        start = True
        while i < end:
            t = self.t[i]
            if (start or t.fresh) and (j := self.statement(i, end, calls)) is not None:
                i, start = max(j, i + 1), True
                continue
            if calls or self.scopes:
                self.call(i, end)
            start = t.text in ("{", "}", ";")
            i += 1

    def statement(self, i: int, end: int, calls: bool) -> int | None:
        """Read a declaration that begins here; where it ends, or None if there is none."""
        first, modifiers = i, []
        while i < end and (self.t[i].kind == "mark" or self.at(i) == "#"):
            word = self.at(i)
            if word[0] == "@" and self.language != "objc":
                j = i + 1
                while self.at(j) == ".":
                    j += 2
                j = self.after(j) if self.at(j) == "(" and not self.t[j].fresh else j
                if self.language == "typescript":
                    modifiers.append("".join(x.text for x in self.t[i:j]))
                i = j
            elif word in MODIFIERS and (self.word(i + 1) or self.at(i + 1)[:1] in ("@", "(", "*", "[", "#", "<")) and not (self.at(i + 1) == "(" and word not in ("private", "fileprivate", "public", "internal")):
                if word not in ("export", "default", "final", "async", "const", "late", "companion", "declare", "annotation") or self.language in ("java", "kotlin", "swift") and word in ("final", "companion"):
                    modifiers.append(word)
                i = self.after(i + 1) if self.at(i + 1) == "(" else i + 1
            else:
                break
        if i >= end:
            return None
        special = {"go": self.go, "objc": self.objc}.get(self.language)
        if special:
            return special(i, end, first, calls)
        word = self.at(i)
        if (j := self.imported(i, end)) is not None:
            return j
        if word == "enum" and self.at(i + 1) == "class":  # kotlin
            return self.type("enum", i + 1, first, end, modifiers)
        if word in TYPES[self.language] and (self.word(i + 1) or word == "object") and not (self.language == "swift" and self.at(i + 1) in ("func", "var", "let")):
            return self.type(TYPES[self.language][word], i, first, end, modifiers)
        return getattr(self, self.language)(i, end, first, modifiers, calls)

    def imported(self, i: int, end: int) -> int | None:
        if self.scopes or self.at(i) not in ("import", "package", "from") and not (self.language == "dart" and self.at(i) in ("export", "part")):
            return None
        j, line = i, self.t[i].line
        while j < end and self.at(j) != ";" and (j == i or not self.t[j].fresh or self.at(j - 1) == "," or self.at(j) == "}"):
            j = self.after(j)
        part = self.t[i + 1 : j]
        if self.at(i) == "import" or self.language == "dart":
            text = next((x.text for x in reversed(part) if x.kind == "text"), None) if self.language in ("typescript", "dart") else None
            if text is None and self.language not in ("typescript", "dart"):
                words = [x.text for x in part if x.text not in ("static", "class", "struct", "func")]
                text = "".join(words[: words.index("as")] if "as" in words else words)
            if text:
                self.imports.append({"imported_path": text.strip("\"'`"), "line": line})
        return j + (self.at(j) == ";")

    def type(self, kind: str, i: int, first: int, end: int, modifiers: list[str]) -> int:
        name = self.at(i + 1) if self.word(i + 1) and self.at(i + 1) not in ("on",) else "Companion"
        if self.language == "swift" and self.at(i) in ("class", "struct", "actor", "extension"):
            modifiers = [*modifiers, self.at(i)]
        j = self.generics(i + 2 if self.word(i + 1) else i + 1)
        header = j
        params = None
        if self.language in ("kotlin", "java"):
            while self.at(j) in ("private", "internal", "public", "protected", "constructor") or self.at(j)[:1] == "@":
                j += 1
            if self.at(j) == "(":
                params, j = j, self.after(j)
        clause = j
        while j < end and self.at(j) not in ("{", ";"):
            if self.t[j].fresh and self.at(j) not in (":", ",", "extends", "implements", "with", "where", "on") and self.at(j - 1) not in (",", ":", "extends", "implements", "with", "&", "on"):
                break
            j = self.after(j)
        last = self.close[j] if j < end and self.at(j) == "{" else max(j - 1, header - 1)
        begin = i if self.language == "typescript" or self.language == "dart" and self.at(first)[:1] == "@" else first
        scope = self.define(name, kind, begin, last, modifiers)
        self.parents(scope, clause, j, i)
        self.scopes.append(scope)
        if params is not None:
            self.constructor_fields(scope, params)
        if j < end and self.at(j) == "{":
            self.fields(scope, j + 1, self.close[j])
            self.body(j + 1, self.close[j], False)
            j = self.close[j] + 1
        self.scopes.pop()
        return j

    def parents(self, scope: Scope, i: int, end: int, line: int) -> None:
        kind = "implements"
        while i < end:
            word = self.at(i)
            if word in ("extends", "implements", "with", "on", ":", ",", "where"):
                kind = {"extends": "extends", "implements": "implements", "with": "implements", "on": "implements"}.get(word, kind)
                if word == "where":
                    return
                i += 1
            elif self.word(i):
                name, j = self.kind(i)
                own = "extends" if self.language == "kotlin" and self.at(j) == "(" else kind
                self.edge(scope.symbol["qualified_name"], name, own, self.t[line].line)
                i = max(self.after(j) if self.at(j) == "(" else j, i + 1)
                while i < end and self.at(i) == "by":
                    i += 2
            else:
                i = self.after(i)

    def constructor_fields(self, scope: Scope, open_: int) -> None:
        """Kotlin: parameters with val or var are properties; all have a type."""
        i, own = open_ + 1, []
        while i < self.close[open_]:
            j, k = i, i
            while j < self.close[open_] and self.at(j) != ",":
                j = self.generics(j) if self.generics(j) > j else self.after(j)
            words = [x for x in range(k, j) if self.word(x)]
            colon = next((x for x in range(k, j) if self.at(x) == ":"), None)
            if colon is not None and self.word(colon - 1):
                scope.types[self.at(colon - 1)] = self.kind(colon + 1)[0]
                if any(self.at(x) in ("val", "var") for x in words):
                    own.append(self.define(self.at(colon - 1), "property", k, j - 1, [self.at(x) for x in words if self.at(x) in MODIFIERS]))
            i = j + 1

    def fields(self, scope: Scope, i: int, end: int) -> None:
        """Types of the names that are declared right inside a type."""
        while i < end:
            if self.word(i) and self.at(i + 1) == ":" and self.word(i + 2):
                scope.types.setdefault(self.at(i), self.kind(i + 2)[0])
            elif self.word(i) and self.at(i)[0].isupper() and self.word(j := self.generics(i + 1)) and self.at(j + 1) in ("=", ";", ","):
                scope.types.setdefault(self.at(j), self.at(i))
            elif self.word(i) and self.at(i + 1) == "=" and self.word(i + 2 + (self.at(i + 2) == "new")) and self.at(i + 2 + (self.at(i + 2) == "new"))[0].isupper():
                scope.types.setdefault(self.at(i), self.at(i + 2 + (self.at(i + 2) == "new")))
            i = self.after(i)

    def function(self, name: str, kind: str, first: int, params: int, modifiers: list[str], end: int, keep: bool = True, signature_only: bool = False) -> int:
        """A function whose parameters open at ``params``: up to its body, then the body."""
        j = self.after(params)
        while j < end and self.at(j) not in ("{", ";", "}", "="):
            if self.t[j].fresh and self.at(j - 1) not in (":", "->", ",", "throws", "where", "|", "&") and self.at(j) not in (":", "->", "throws", "where", "async", "|", "&", "rethrows"):
                break
            if self.at(j) == "=>":
                break
            j = self.generics(j) if self.at(j) == "<" and self.generics(j) > j else self.after(j)
        block = j < end and self.at(j) == "{"
        short = j < end and self.at(j) in ("=", "=>")
        stop = self.close[j] if block else j
        if short:  # one expression, to the end of its statement
            stop = j + 1
            while stop < end and self.at(stop) not in (";", "}", ",") and not (self.t[stop].fresh and stop > j + 1 and self.at(stop) not in (".", "?.", "?", ":", "&&", "||") and self.at(stop - 1) not in ("=", "=>", "(", ",", "+", "?", ":")):
                stop = self.after(stop)
        last = stop if block else (stop - 1 if short and not signature_only else j - 1 if not block else j)
        scope = self.define(name, kind, first, (j - 1) if signature_only else last, modifiers, keep)
        if not keep:
            scope.symbol = None
        self.scopes.append(scope if keep else Scope("", "code", None))
        self.parameters(self.scopes[-1], params)
        if name == "constructor" and self.inside():  # parameters may declare fields
            self.inside().types |= self.scopes[-1].types
        if block:
            self.body(j + 1, self.close[j], True)
        elif short:
            self.body(j + 1, stop, True)
        self.scopes.pop()
        return stop + 1 if block or self.at(stop) == ";" else stop

    def parameters(self, scope: Scope, open_: int) -> None:
        for i in range(open_ + 1, self.close.get(open_, open_)):
            if self.word(i) and self.at(i + 1) == ":" and self.word(i + 2):
                scope.types[self.at(i)] = self.kind(i + 2)[0]
            elif self.word(i) and self.at(i + 1) in (",", ")", "=") and self.language in ("java", "dart"):
                back = i - 1
                if self.at(back) == ">":
                    while back > open_ and self.at(back) != "<":
                        back -= 1
                    back -= 1
                if self.word(back) and self.at(back)[0].isupper():
                    scope.types[self.at(i)] = self.at(back)

    # --- calls ------------------------------------------------------------------------
    def call(self, i: int, end: int) -> None:
        """A local's type, or a call that begins with the name here."""
        if not self.word(i):
            return
        name = self.at(i)
        if self.scopes and name in ("val", "var", "let", "const", "final") and self.word(i + 1):
            self.local(i + 1)
            return
        if self.scopes and self.language in ("java", "dart") and name[0].isupper() and self.word(self.generics(i + 1)) and self.at(self.generics(i + 1) + 1) in ("=", ";"):
            self.scopes[-1].types[self.at(self.generics(i + 1))] = name
            return
        j = self.generics(i + 1) if self.at(i + 1) == "<" and self.at(self.generics(i + 1)) == "(" else i + 1
        if self.at(j) != "(" and not (self.at(j) == "{" and self.language == "kotlin" and self.at(i - 1) in (".", "?.")):
            return
        if name in NO_CALL and not (name == "init" and self.at(i - 1) == ".") or self.language == "go" and name in GO_WORDS:
            return
        self.edge(self.owner(), name, "calls", self.t[i].line, self.receiver(i))

    def local(self, i: int) -> None:
        if self.at(i + 1) == ":":
            self.scopes[-1].types[self.at(i)] = self.kind(i + 2)[0]
            return
        j = i + 2 if self.at(i + 1) == "=" else None
        if j is not None:
            j += self.at(j) in ("new", "await")
            if self.word(j) and self.at(j)[0].isupper() and self.at(self.generics(j + 1)) == "(":
                self.scopes[-1].types[self.at(i)] = self.at(j)

    def receiver(self, i: int) -> str | None:
        """The type that a call's receiver is known to have."""
        if self.at(i - 1) not in (".", "?."):
            return None
        r = i - 2
        if self.at(r) in ("!", "?"):
            r -= 1
        if self.at(r) == ")":
            made = next((a for a, b in self.close.items() if b == r), None)
            name = self.at(made - 1) if made else ""
            return name if name[:1].isupper() and self.at(made - 2) not in (".", "?.") else None
        name = self.at(r)
        if name in ("this", "self"):
            return self.inside().name if self.inside() else None
        if not self.word(r):
            return None
        if self.at(r - 1) in (".", "?.") and self.at(r - 2) in ("this", "self"):
            return self.inside().types.get(name) if self.inside() else None
        if self.at(r - 1) in (".", "?."):
            return None
        known = next((s.types[name] for s in reversed(self.scopes) if name in s.types), None)
        return known or (name if name[:1].isupper() else None)

    # --- languages --------------------------------------------------------------------
    def java(self, i: int, end: int, first: int, modifiers: list[str], calls: bool) -> int | None:
        if calls or not self.inside():
            return None
        i = self.generics(i)
        if self.at(i) == self.inside().name and self.at(i + 1) == "(":
            return self.function(self.at(i), "constructor", first, i + 1, modifiers, end, keep=False)
        name, j = self.kind(i)
        if not name or j <= i or not self.word(j):
            return None
        if self.at(j + 1) == "(":
            return self.function(self.at(j), "method", first, j + 1, modifiers, end)
        if self.at(j + 1) not in ("=", ";", ",", "["):
            return None
        stop = j
        names = [j]
        while stop < end and self.at(stop) != ";":
            if self.at(stop) == "," and self.word(stop + 1) and self.at(stop + 2) in ("=", ";", ","):
                names.append(stop + 1)
            stop = self.generics(stop) if self.at(stop) == "<" and self.generics(stop) > stop else self.after(stop)
        for n in names:
            self.define(self.at(n), "property", first, stop, modifiers)
        self.body(j + 1, stop, False)
        return stop + 1

    def kotlin(self, i: int, end: int, first: int, modifiers: list[str], calls: bool) -> int | None:
        if self.at(i) != "fun":
            return None
        j = self.generics(i + 1)
        while self.word(j) and self.at(self.generics(j + 1)) in (".", "?"):  # the type that is extended
            j = self.generics(j + 1)
            j += 1 + (self.at(j) == "?" and self.at(j + 1) == ".")
        if not self.word(j) or self.at(j + 1) != "(":
            return None
        return self.function(self.at(j), "method" if self.inside() and not calls else "function", first, j + 1, modifiers, end)

    def typescript(self, i: int, end: int, first: int, modifiers: list[str], calls: bool) -> int | None:
        word = self.at(i)
        if word == "function":
            j = i + 1 + (self.at(i + 1) == "*")
            open_ = self.generics(j + 1)
            return self.function(self.at(j), "function", i, open_, modifiers, end) if self.word(j) and self.at(open_) == "(" else None
        if word == "type" and self.word(i + 1) and self.at(self.generics(i + 2)) == "=" and not calls:
            stop = self.generics(i + 2)
            while stop < end and self.at(stop) != ";" and not (self.t[stop].fresh and self.at(stop) not in ("|", "&") and self.at(stop - 1) not in ("=", "|", "&")):
                stop = self.after(stop)
            self.define(self.at(i + 1), "type", first, stop - 1, modifiers)
            return stop
        at_const = next((k for k in range(first, i + 1) if self.at(k) in ("const", "let", "var")), None)
        if at_const is not None and not calls and not self.inside():
            j = at_const + 1
            k = j + 1
            if self.at(k) == ":":
                while k < end and self.at(k) not in ("=", ";"):
                    k = self.after(k)
            if self.word(j) and self.at(k) == "=":
                k += 1 + (self.at(k + 1) == "async")
                open_ = self.generics(k)
                if self.at(k) == "function":
                    open_ = next((x for x in range(k, min(k + 4, end)) if self.at(x) == "("), k)
                arrow = self.at(open_) == "(" and (self.at(k) == "function" or any(self.at(x) == "=>" for x in self._until(self.after(open_), end)))
                if arrow:
                    return self.function(self.at(j), "function", at_const, open_, modifiers, end)
                if self.word(k) and self.at(k + 1) == "=>":
                    scope = self.define(self.at(j), "function", at_const, self.close.get(k + 2, k + 2), modifiers)
                    self.scopes.append(scope)
                    stop = self.after(k + 2) if self.at(k + 2) == "{" else k + 2
                    self.body(k + 2, max(stop, k + 3), True)
                    self.scopes.pop()
                    return max(stop, k + 3)
                self.define(self.at(j), "variable", at_const, k, modifiers)
                return k
            return None
        scope = self.inside()
        if calls or not scope or self.scopes[-1] is not scope or scope.kind not in ("class", "interface"):
            return None
        j = i + (word in ("get", "set", "*") and (self.word(i + 1)))
        if not self.word(j) and self.at(j) != "#":
            return None
        k = j + 1 + (self.at(j + 1) in ("?", "!"))
        open_ = self.generics(k)
        start = next((x for x in range(first, i + 1) if self.at(x)[:1] != "@" and (self.at(x) in MODIFIERS or x == i)), i)
        if self.at(open_) == "(" and scope.kind == "class":
            return self.function(self.at(j), "method", start, open_, modifiers, end)
        if self.at(k) in (":", "=", ";") and scope.kind == "class":
            stop = k
            while stop < end and self.at(stop) != ";" and not (self.t[stop].fresh and stop > k and self.at(stop - 1) not in ("=", ":", "|", "=>")):
                stop = self.generics(stop) if self.at(stop) == "<" and self.generics(stop) > stop else self.after(stop)
            self.define(self.at(j), "property", start, stop - 1, modifiers)
            self.body(k, stop, False)
            return stop
        return None

    def _until(self, i: int, end: int) -> range:
        """Places up to the end of a return type before an arrow."""
        j = i
        while j < end and self.at(j) not in (";", "{", "=>") and not (self.t[j].fresh and j > i):
            j = self.after(j)
        return range(i, min(j + 1, end))

    def swift(self, i: int, end: int, first: int, modifiers: list[str], calls: bool) -> int | None:
        if self.at(i) == "func" and i + 1 < end:
            open_ = self.generics(i + 2)
            if self.at(open_) == "(":
                kind = "method" if self.inside() and not calls else "function"
                stop = self.function(self.at(i + 1), kind, first, open_, modifiers, end, keep=not (self.inside() and self.inside().kind == "interface"))
                return stop
        if self.at(i) == "init" and self.inside() and not calls:
            open_ = self.generics(i + 1 + (self.at(i + 1) in ("?", "!")))
            if self.at(open_) == "(":
                return self.function("init", "constructor", first, open_, modifiers, end, keep=False)
        return None

    def dart(self, i: int, end: int, first: int, modifiers: list[str], calls: bool) -> int | None:
        start = next((x for x in range(first, i + 1) if self.at(x)[:1] != "@"), i)
        scope = self.inside()
        if calls:
            return None
        modifiers = [m for m in modifiers if m in ("abstract", "static")]
        if scope and self.scopes[-1] is scope:
            if self.at(i) in (scope.name, "factory"):
                j = i + (self.at(i) == "factory")
                named = j + 2 if self.at(j + 1) == "." else j
                if self.at(named + 1) == "(":
                    name = scope.name if named == j else f"{scope.name}.{self.at(named)}"
                    stop = self.after(named + 1)
                    self.define(name.split(".")[-1], "constructor", start, self.close.get(named + 1, named), modifiers)
                    while stop < end and self.at(stop) not in ("{", ";"):
                        stop = self.after(stop)
                    if self.at(stop) == "{":
                        self.scopes.append(Scope("", "code", None))
                        self.body(stop + 1, self.close[stop], True)
                        self.scopes.pop()
                    return self.after(stop)
        name, j = self.kind(i)
        if name and self.at(j) == "(" and self.word(i) and j == i + 1 and (not scope or self.scopes[-1] is scope) and name not in NO_CALL:
            return self.function(name, "method" if scope else "function", start, j, modifiers, end, signature_only=True)
        if not name or not self.word(j) or self.at(j) in ("get", "set", "operator"):
            return None
        if self.at(self.generics(j + 1)) == "(":
            return self.function(self.at(j), "method" if scope else "function", start, self.generics(j + 1), modifiers, end, signature_only=True)
        if scope and self.scopes[-1] is scope and self.at(j + 1) in ("=", ";", ","):
            stop = j
            while stop < end and self.at(stop) != ";":
                stop = self.after(stop)
            self.define(self.at(j), "property", start, stop, modifiers)
            self.body(j + 1, stop, False)
            return stop + 1
        return None

    def go(self, i: int, end: int, first: int, calls: bool) -> int | None:
        word = self.at(i)
        if word in ("import", "package") and not self.scopes:
            stop = self.after(i + 1)
            if word == "import":
                self.imports += [{"imported_path": t.text.strip("\"`"), "line": t.line} for t in self.t[i + 1 : stop + (self.t[min(i + 2, end - 1)].kind == "text")] if t.kind == "text"]
            return stop
        if word == "type" and not calls:
            if self.at(i + 1) == "(":
                j = i + 2
                while j < self.close[i + 1]:
                    j = max(self.go_type(j, j, self.close[i + 1]), j + 1)
                return self.close[i + 1] + 1
            return self.go_type(i + 1, i, end)
        if word == "func" and not calls:
            j, receiver = i + 1, None
            if self.at(j) == "(":
                parts = [x for x in range(j + 1, self.close[j]) if self.word(x)]
                receiver = (self.at(parts[0]), self.at(parts[1] if len(parts) > 1 else parts[0])) if parts else None
                j = self.after(j)
            open_ = self.after(j + 1) if self.at(j + 1) == "[" else j + 1
            if not self.word(j) or self.at(open_) != "(":
                return None
            stop = self.after(open_)
            while stop < end and self.at(stop) != "{" and not self.t[stop].fresh:
                stop = self.after(stop)
            block = self.at(stop) == "{"
            scope = self.define(self.at(j), "method" if receiver else "function", i, self.close[stop] if block else stop - 1, [])
            if receiver:
                scope.types[receiver[0]] = receiver[1]
            for x in range(open_ + 1, self.close[open_]):
                if self.word(x) and self.at(x + 1) in ("*",) + (() if not self.word(x + 1) else (self.at(x + 1),)):
                    scope.types.setdefault(self.at(x), self.kind(x + 1)[0])
            self.scopes.append(scope)
            if block:
                self.body(stop + 1, self.close[stop], True)
            self.scopes.pop()
            return self.after(stop) if block else stop
        return None

    def go_type(self, i: int, first: int, end: int) -> int:
        j = self.after(i + 1) if self.at(i + 1) == "[" else i + 1
        kind = {"struct": "class", "interface": "interface"}.get(self.at(j))
        if not kind or self.at(j + 1) != "{":
            return j
        self.define(self.at(i), kind, i, self.close[j + 1])
        return self.close[j + 1] + 1

    def objc(self, i: int, end: int, first: int, calls: bool) -> int | None:
        word = self.at(i)
        if word in ("#import", "@import") or word == "#" and self.at(i + 1) == "import":
            j, line = i + 1, self.t[i].line
            while j < end and self.t[j].line == line:
                j += 1
            path = "".join(t.text for t in self.t[i + 1 : j]).strip('<>";@')
            self.imports.append({"imported_path": path, "line": line})
            return j
        if word in ("@interface", "@protocol", "@implementation") and self.word(i + 1):
            stop = next((k for k in range(i, end) if self.at(k) == "@end"), end - 1)
            if word == "@protocol" and self.at(i + 2) in (";", ","):
                return i + 3
            name, j, kind = self.at(i + 1), i + 2, "protocol" if word == "@protocol" else "class"
            if self.at(j) == "(":
                category = self.at(j + 1)
                j = self.after(j)
                if self.word(j - 2) and category != ")":
                    self.define(category, "category", i, stop)
            scope = self.define(name, kind, i, stop) if not (word != "@protocol" and self.at(i + 2) == "(") else Scope(name, "category", {"qualified_name": ".".join([*self.prefix, name])})
            if self.at(j) == ":" and self.word(j + 1):
                self.edge(scope.symbol["qualified_name"], self.at(j + 1), "extends", self.t[i].line)
                j += 2
            if self.at(j) == "<":
                while j < stop and self.at(j) != ">":
                    if self.word(j):
                        self.edge(scope.symbol["qualified_name"], self.at(j), "extends" if kind == "protocol" else "implements", self.t[i].line)
                    j += 1
            self.scopes.append(scope)
            while j < stop:
                j = max(self.objc_member(j, stop), j + 1)
            self.scopes.pop()
            return stop + 1
        return None

    def objc_member(self, i: int, end: int) -> int:
        if self.at(i) == "@property":
            stop = i
            while stop < end and self.at(stop) != ";":
                stop = self.after(stop)
            name = next((k for k in range(stop - 1, i, -1) if self.word(k)), None)
            if name is not None:
                self.define(self.at(name), "property", i, stop)
            return stop + 1
        if self.at(i) in ("-", "+") and self.at(i + 1) == "(" and self.t[i].fresh:
            j = self.after(i + 1)
            stop = j
            while stop < end and self.at(stop) not in ("{", ";"):
                stop = self.after(stop)
            block = self.at(stop) == "{"
            scope = self.define(self.at(j), "method", i, self.close[stop] if block else stop, ["instance_method" if self.at(i) == "-" else "class_method"])
            self.scopes.append(scope)
            if block:
                self.objc_calls(stop + 1, self.close[stop])
            self.scopes.pop()
            return self.after(stop) if block else stop + 1
        return i + 1

    def objc_calls(self, i: int, end: int) -> None:
        """Message sends, the outermost first, and calls of functions."""
        for k in range(i, end):
            if self.at(k) == "[" and k in self.close and (self.word(k + 1) or self.at(k + 1) == "[") and self.at(k - 1) not in (")", "]") and not (self.word(k - 1) and self.at(k - 1) != "return"):
                named = self.after(k + 1) if self.at(k + 1) == "[" else k + 2
                while self.at(named) == "." and self.word(named + 1):
                    named += 2
                if self.word(named) and named < self.close[k]:
                    target = self.at(k + 1)
                    own = self.inside().name if target == "self" and self.inside() else target if target[:1].isupper() else None
                    self.edge(self.owner(), self.at(named), "calls", self.t[k].line, own)
            elif self.word(k) and self.at(k + 1) == "(" and self.at(k) not in NO_CALL:
                self.edge(self.owner(), self.at(k), "calls", self.t[k].line)


def parse(text: str, language: str, stem: str = "") -> tuple[list[dict], list[dict], list[dict]]:
    """symbols, edges and imports of a file; stem is its name, which scopes some languages."""
    seen = Reader(text, language, stem).read()
    return seen.symbols, seen.edges, seen.imports
