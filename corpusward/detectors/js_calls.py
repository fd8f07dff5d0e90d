"""Calls, pairs, assignments and attributes of JavaScript and TypeScript sources as rows.

One pass makes tokens and keeps a stack of what is open: brackets, templates, tags and their text. So it
knows whether a slash divides or begins a regular expression, whether a brace holds statements or
properties, and where nested templates and markup go back to code. A second pass reads the rows off
the tokens; what an expression is follows from the loosest operator outside its brackets. Both
passes look at each token a bounded number of times."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "struct<what:string,name:string,callee:string,line:int,col:int,text:string,kind:string,dynamic:boolean,any_dynamic:boolean,literal:string,first:string,second:string,props:map<string,string>,shell_bound:boolean>"
_FIELDS = [
    "what", "name", "callee", "line", "col", "text", "kind", "dynamic", "any_dynamic", "literal", "first",
    "second", "props", "shell_bound",
]
_MODULE = r"[\"'](?:node:)?child_process[\"']"
_SHELL = frozenset(["exec", "execSync", "execFile", "execFileSync", "spawn", "spawnSync"])
_PAIRS = frozenset(["rejectUnauthorized", "Access-Control-Allow-Origin", "access-control-allow-origin"])

# The language's own words and signs. Fixed values.
#: Words behind which an expression begins.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do yield await instanceof extends default".split())
_NO_CALL = _BEFORE_VALUE | frozenset("if for while switch catch function super with import".split())
_MODIFIERS = frozenset("get set async static public private protected readonly abstract override declare".split())
_BINARY = frozenset("+ - * / % ** < > <= >= == != === !== && || ?? & | ^ << >> >>> in instanceof".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset("! ~ + - ++ -- typeof void delete await new yield ...".split())
_TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|\A\#!.*)
    |(?P<str>"(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?)
    |(?P<num>\.?\d[\w.]*)
    |(?P<name>\#?[A-Za-z_$\u0080-￿\U00010000-\U0010ffff][\w$]*)
    |(?P<op>\.\.\.|=>|\?\.(?!\d)|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\*\*|\+\+|--|<<|==|!=|<=|>=|&&|\|\||\?\?|[-+*/%&|^]=|[\s\S])""",
    re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_TYPES = re.compile(r"<(?P<in>[\w$\s.,|&\[\]?'\"<>]{0,200}+)")
_TAG = re.compile(r"<(?P<name>[A-Za-z_$][\w$.:-]*|(?=>))(?=[\s/>])")
_MARKUP, _CALLED = re.compile(r"[<{]"), re.compile(r"\s*[(`]")
_CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}


class Tokens:
    """kinds, starts, ends of the tokens; match: for brackets the other one; opener: the bracket that a
    token stands in; role: of a brace, `block`, `class` or `object`."""

    def __init__(self, source: str):
        self.source = source
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.match: dict[int, int] = {}
        self.opener: list[int] = []
        self.role: dict[int, str] = {}
        self.blanks: list[tuple[int, int]] = []
        self.words: list[str] = []
        self.stack: list[int] = []
        self.last: dict[str, int] = {}
        self._read()

    def _add(self, kind: str, start: int, end: int) -> int:
        self.kinds.append(kind)
        self.starts.append(start)
        self.ends.append(end)
        self.words.append(self.source[start:end] if end - start < 400 else self.source[start : start + 400])
        self.opener.append(self.stack[-1] if self.stack else -1)
        return len(self.kinds) - 1

    def value_next(self) -> bool:
        """May an expression begin here, rather than an operator?"""
        if not self.kinds:
            return True
        kind, word, k = self.kinds[-1], self.words[-1], len(self.kinds) - 1
        if kind == "name":
            return word in _BEFORE_VALUE and not (k and self.words[k - 1] in (".", "?."))
        if word == ")" and k in self.match:
            before = self.match[k] - 1
            return before >= 0 and self.words[before] in ("if", "while", "for", "with") and not (before and self.words[before - 1] == ".")
        if word == "}" and k in self.match:
            return self.role.get(self.match[k]) in ("block", "class")
        return kind == "op" and word not in ("]", ")", "++", "--") or kind == "tagend"

    def _brace(self) -> str:
        """What a brace that opens here holds."""
        k = len(self.kinds) - 1
        if k < 0:
            return "block"
        if self.stack and self.role.get(self.stack[-1]) == "tag":
            return "sub"
        if self.stack and self.stack[-1] == k and self.role.get(k) == "sub":
            return "object"
        word, kind = self.words[k], self.kinds[k]
        if kind == "name" and word not in _BEFORE_VALUE or word == "}":
            low = k  # back over the head of a class: names, types, dots, commas
            while low >= 0 and low > k - 30 and (self.kinds[low] in ("name", "types") or self.words[low] in (".", ",")):
                if self.words[low] in ("class", "interface", "enum"):
                    return "class"
                low -= 1
            return "block"
        if word == ")":
            return "block"
        if kind == "types":
            return "class"
        if kind == "name":
            return "block" if word in ("else", "do") else "object"
        if word == ":":  # of a case, of a type, or of a property
            return "object"
        return "block" if word in (";", "{", "=>") or kind == "tagend" else "object"

    def _open(self, word: str, start: int, end: int, role: str | None = None) -> None:
        role = role or (self._brace() if word == "{" else None)
        k = self._add("op", start, end)
        if role:
            self.role[k] = role
        self.stack.append(k)

    def _close(self, word: str, start: int, end: int) -> None:
        while self.stack and _CLOSE.get(self.words[self.stack[-1]]) != word and self.words[self.stack[-1]] not in ("${", "`", "<>"):
            self.stack.pop()  # never closed
        if self.stack and _CLOSE.get(self.words[self.stack[-1]]) == word:
            opened = self.stack.pop()
            k = self._add("op", start, end)
            self.match[k], self.match[opened] = opened, k
        else:
            self._add("op", start, end)

    def _chunk(self, i: int) -> int:
        """A template's text up to its end or its next substitution."""
        end = _CHUNK.match(self.source, i).end()
        if end > i:
            self._add("chunk", i, end)
        if self.source.startswith("${", end):
            self._open("${", end, end + 2, "sub")
            return end + 2
        if end < len(self.source) and self.source[end] == "`":
            opened = self.stack.pop()
            k = self._add("tpl", end, end + 1)
            self.match[k], self.match[opened] = opened, k
            return end + 1
        return max(end, i + 1)

    def _markup(self, i: int) -> int:
        """The text between tags, up to the next tag or brace."""
        s = self.source
        m = _MARKUP.search(s, i)
        end = m.start() if m else len(s)
        if s.startswith("</", end):
            close = s.find(">", end)
            self.stack.pop()
            self._add("tagend", end, close + 1 if close >= 0 else len(s))
            return close + 1 if close >= 0 else len(s)
        if end < len(s) and s[end] == "{":
            self._open("{", end, end + 1, "sub")
            return end + 1
        return self._tag(end) if end < len(s) else end

    def _closes(self, name: str, i: int) -> bool:
        """Is there an end to a tag of this name behind i? Else `<` begins types or compares."""
        if name not in self.last:
            self.last[name] = self.source.rfind("</" + name)
        return self.last[name] > i or self.source.find("/>", i, i + 4000) >= 0

    def _tag(self, i: int) -> int:
        """An opening tag's `<` and name; attributes are tokens as elsewhere, up to its end."""
        m = _TAG.match(self.source, i)
        if not m:
            self._add("op", i, i + 1)
            return i + 1
        self._open("<tag", i, m.end(), "tag")
        self.words[-1] = "<tag"
        return m.end()

    def _read(self) -> None:
        s, n, i = self.source, len(self.source), 0
        while i < n:
            top = self.words[self.stack[-1]] if self.stack else ""
            if top == "`":
                i = self._chunk(i)
                continue
            if top == "<>":
                i = self._markup(i)
                continue
            if top == "<tag" and s[i] in "/>":
                opened = self.stack.pop()
                end = i + 2 if s.startswith("/>", i) else i + 1
                self.match[opened] = self._add("tagend", i, end)
                if s[i] == ">":
                    self.stack.append(self._add("op", end, end))
                    self.words[-1] = "<>"
                i = end
                continue
            m = _TOKEN.match(s, i)
            kind, word, end = m.lastgroup, m.group(), m.end()
            if kind == "blank":
                self.blanks.append((i, end))
            elif word == "/" and self.value_next() and (r := _REGEX.match(s, i)):
                end = r.end()
                self._add("regex", i, end)
            elif word == "/=" and self.value_next() and (r := _REGEX.match(s, i)):
                end = r.end()
                self._add("regex", i, end)
            elif word == "<" and self.value_next() and (t := _TAG.match(s, i)) and self._closes(t.group("name"), i):
                end = self._tag(i)
            elif word == "<" and self.kinds and self.kinds[-1] == "name" and not self.value_next() and (k := self._types(i)):
                end = k
                self._add("types", i, end)
            elif word == "`":
                self.stack.append(self._add("tpl", i, end))
            elif word in _CLOSE:
                self._open(word, i, end)
            elif word in (")", "]", "}"):
                self._close(word, i, end)
            else:
                self._add(kind, i, end)
            i = end

    def _types(self, i: int) -> int:
        """The end of type arguments before a call or template that begin at i, or 0."""
        end, depth = _TYPES.match(self.source, i).end(), 0
        for both in ("&&", "||"):
            found = self.source.find(both, i, end)
            end = found if found >= 0 else end
        for k in range(i, end):
            depth += (self.source[k] == "<") - (self.source[k] == ">")
            if depth == 0:
                return k + 1 if _CALLED.match(self.source, k + 1) else 0
        return 0

    def skip(self, k: int) -> int:
        """The token that ends what begins at k: of a bracket, the other one."""
        return max(k, self.match.get(k, k))


def blanked(s: str) -> str:
    """s with comments blank and the insides of strings as underscores, at the same places."""
    tokens, out = Tokens(s), list(s)
    inside = [(a, b, " ") for a, b in tokens.blanks]
    for k, kind in enumerate(tokens.kinds):
        a, b = tokens.starts[k], tokens.ends[k]
        if kind in ("str", "regex"):
            inside.append((a + 1, b - 1, "_"))
        elif kind == "tpl" and tokens.match.get(k, 0) > k and not (tokens.opener[k] >= 0 and tokens.role.get(tokens.opener[k]) == "sub"):
            inside.append((b, tokens.starts[tokens.match[k]], "_"))
    for a, b, fill in inside:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = fill
    return "".join(out)


def _bindings(source: str) -> tuple[set[str], set[str]]:
    """Local names of child_process functions, and of the module."""
    direct, spaces = set(), set()
    for p in (rf"import\s*\{{([^{{}}]+)\}}\s*from\s*{_MODULE}", rf"(?:const|let|var)\s*\{{([^{{}}]+)\}}\s*=\s*require\(\s*{_MODULE}\s*\)"):
        for m in re.finditer(p, source):
            for item in m.group(1).split(","):
                parts = [x.strip() for x in re.split(r"\s+(?:as|:)\s+", item.strip())]
                if parts[0] in _SHELL:
                    direct.add(parts[-1])
    for p in (rf"import\s+(?:\*\s+as\s+)?([A-Za-z_$][\w$]*)\s+from\s+{_MODULE}", rf"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\(\s*{_MODULE}\s*\)"):
        spaces |= {m.group(1) for m in re.finditer(p, source)}
    return direct, spaces


class Reader:
    """The rows of a source's tokens."""

    def __init__(self, source: str):
        self.source, self.t = source, Tokens(source)
        self.direct, self.spaces = _bindings(source)
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.values: dict[tuple[int, int], tuple[str, bool, str]] = {}
        self.starts_of: dict[int, int] = {}

    def said(self, low: int, high: int) -> str:
        """The source of the tokens from low up to, not with, high."""
        return self.source[self.t.starts[low] : self.t.ends[high - 1]] if low < high else ""

    def pieces(self, low: int, high: int) -> list[tuple[int, int]]:
        """Ranges of tokens between the commas that are in no bracket."""
        out, start, k = [], low, low
        while k < high:
            if self.t.words[k] == "," and self.t.kinds[k] == "op":
                out.append((start, k))
                start = k + 1
            k = self.t.skip(k) + 1
        out.append((start, high))
        return [(a, b) for a, b in out if a < b]

    def value(self, low: int, high: int) -> tuple[str, bool, str]:
        """(kind, is it put together at run time, its string pieces) of an expression's tokens."""
        if (low, high) not in self.values:
            self.values[low, high] = self._value(low, high)
        return self.values[low, high]

    def _template(self, low: int) -> tuple[bool, str]:
        """(are there substitutions, the text between them) of the template that begins at low."""
        parts, k, dynamic = [], low + 1, False
        while k < self.t.match.get(low, len(self.t.kinds)):
            if self.t.kinds[k] == "chunk":
                parts.append(self.source[self.t.starts[k] : self.t.ends[k]])
            dynamic |= self.t.words[k] == "${"
            k = self.t.skip(k) + 1
        return dynamic, " ".join(parts)

    def _value(self, low: int, high: int) -> tuple[str, bool, str]:
        t, other = self.t, ("other", False, "")
        if low >= high or t.words[low] in ("function", "class") or (t.words[low] == "async" and low + 1 < high and t.words[low + 1] == "function"):
            return other
        operators, k, operand = [], low, False
        while k < high:
            word, kind = t.words[k], t.kinds[k]
            if kind == "op" and word in ("=>", "?", "...") or kind == "op" and word in _ASSIGN or kind == "name" and operand and word in ("as", "satisfies"):
                return other
            if operand and word in _BINARY and kind in ("op", "name"):
                operators.append(k)
                operand = False
            elif kind == "op" and word in (".", "?.") or not operand and word in _UNARY and kind in ("op", "name"):
                pass
            else:
                operand = True
            k = t.skip(k) + 1
        if operators:
            parts, start = [], low
            for at in [*operators, high]:
                if start < at:
                    parts.append(self.value(start, at))
                start = at + 1
            return "binary", True, " ".join(p[2] for p in parts if p[2] and p[0] in ("string", "template"))
        if t.words[low] in _UNARY and t.kinds[low] in ("op", "name"):
            return other
        last, word = high - 1, t.words[high - 1]
        if t.kinds[low] == "str" and low == last:
            return "string", False, re.sub(r"^[\"'`]|[\"'`]$", "", self.said(low, high))
        if t.kinds[low] == "tpl" and t.skip(low) == last:
            return ("template", *self._template(low))
        if t.kinds[low] == "name" and low == last:
            return other if word in ("true", "false", "null", "undefined", "this", "super") else ("identifier", True, "")
        if t.skip(low) == last and t.words[low] in ("{", "["):
            if t.words[low] == "{":
                return "object", False, ""
            return "array", any(self.value(a, b)[1] for a, b in self.pieces(low + 1, last) if t.words[a] != "{"), ""
        if word == ")" and last in t.match and t.match[last] > low or t.kinds[last] == "tpl" and t.match.get(last, last) > low:
            return "call", True, ""
        if t.kinds[last] == "name" and last > low and t.words[last - 1] in (".", "?."):
            return "member", True, ""
        return other

    def chain(self, last: int) -> int:
        """The first token of the chain of names, calls and brackets that ends with `last`."""
        k = last
        while True:
            if k in self.starts_of:
                k = self.starts_of[k]
                break
            if k in self.t.match and self.t.match[k] < k:
                k = self.t.match[k]
            before = k - 1
            if before < 0:
                break
            word, kind = self.t.words[before], self.t.kinds[before]
            if word in (".", "?.") and kind == "op" and before:
                k = before - 1
            elif self.t.words[k] in ("(", "[", "`") and (kind in ("types", "tpl") or kind == "name" and word not in _NO_CALL - {"super", "import"} or word in (")", "]", "!") and before in self.t.match):
                k = before
            elif kind == "name" and self.t.kinds[k] == "types":
                k = before
            else:
                break
        self.starts_of[last] = k
        return k

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_left(self.breaks, at)
        return line + 1, at - (self.breaks[line - 1] if line else -1)

    def _defines(self, first: int, close: int) -> bool:
        """Is a name with brackets behind it a definition rather than a call?"""
        t = self.t
        before = t.words[first - 1] if first else ""
        if before == "function" or before == "*" and first > 1 and t.words[first - 2] in ("function", "yield"):
            return before != "*" or t.words[first - 2] == "function"
        inside = t.role.get(t.opener[first]) if t.opener[first] >= 0 else None
        after = t.words[close + 1] if close + 1 < len(t.words) else ""
        if t.words[first] == "async" and after in ("=>", ":"):
            return True
        if inside in ("class", "object") and (before in ("{", "}", ";", ",", "*") or before in _MODIFIERS or inside == "class" and before != "=" and t.kinds[first - 1] in ("str", "num")):
            return after in ("{", ":") or inside == "class"
        return after == "{" and inside == "class"

    def calls(self) -> Iterator[tuple]:
        t = self.t
        for opened, word in enumerate(t.words):
            if word != "(" or t.kinds[opened] != "op" or opened not in t.match or not opened:
                continue
            last = opened - 1
            if t.kinds[last] == "types":
                last -= 1
            if t.words[last] == "?." and last:
                last -= 1
            name = t.words[last]
            if t.kinds[last] != "name" or name in _NO_CALL and not (last and t.words[last - 1] in (".", "?.")):
                continue
            first, close = self.chain(last), t.match[opened]
            if first and t.words[first - 1] == "new" and t.kinds[first - 1] == "name" and not any(t.words[k] in ("(", "`") for k in range(first, last)):
                continue  # an object is made, nothing is called
            if first == last and self._defines(first, close):
                continue
            plain = t.kinds[first] == "name" and all(t.kinds[k] == "name" or t.words[k] in (".", "?.") for k in range(max(first, last - 200), last))
            low = first
            if not plain:  # from the last that is no name on
                low = last
                while low - 2 >= first and t.words[low - 1] in (".", "?.") and t.kinds[low - 2] == "name":
                    low -= 2
            callee = ("" if plain else ".") + re.sub(r"\s|\?(?=\.)", "", self.said(low, last + 1))
            args = self.pieces(opened + 1, close)
            values = [self.value(a, b) for a, b in args]
            props: dict[str, str] = {}
            for (a, b), v in zip(args, values):
                if v[0] == "object" and not props:
                    for x, y in self.pieces(a + 1, b - 1):
                        colon = y - x > 1 and t.words[x + 1] == ":"
                        props[self.said(x, x + 1 if colon else y).strip("\"'")] = self.said(x + 2, y) if colon else ""
            required = not plain and bool(re.match(rf"require\(\s*{_MODULE}\s*\)\s*\.", self.source[t.starts[first] : t.starts[first] + 80]))
            bound = required or (callee in self.direct if "." not in callee else callee.split(".")[0] in self.spaces)
            head = values[0] if values else ("", False, "")
            said = [self.said(a, b) for a, b in args[:2]]
            start = t.starts[first if plain or required else low]
            text = self.source[start : min(t.ends[close], start + 400)]
            yield ("call", name, callee, *self.place(start), text, head[0], head[1], any(v[1] for v in values if v[0] != "object"), head[2], said[0] if said else "", said[1] if len(said) > 1 else "", props, bound)

    def _end(self, low: int) -> int:
        """The token behind the value that begins at low: a comma, a semicolon, a bracket that closes, or
        what stands on another line and can't go on with it."""
        t, k, operand = self.t, low, False
        while k < len(t.words):
            word, kind = t.words[k], t.kinds[k]
            if kind == "op" and (word in (",", ";", ")", "]", "}") or kind == "tagend"):
                return k
            line = operand and "\n" in self.source[t.ends[k - 1] : t.starts[k]]
            if line and not (kind == "op" and (word in _BINARY or word in _ASSIGN or word in (".", "?.", "?", ":", "=>", "(", "[")) or kind == "tpl" or word in ("in", "instanceof", "as")):
                return k
            operand = not (kind == "op" and word not in (")", "]", "}", "(", "[", "{", "++", "--") or kind == "name" and word in _BEFORE_VALUE)
            k = t.skip(k) + 1
        return k

    def named(self) -> Iterator[tuple]:
        """Pairs, assignments and attributes that matter."""
        t = self.t
        for k, word in enumerate(t.words):
            kind = t.kinds[k]
            if kind == "op" and word == ":" and k and word == t.words[k]:
                key = t.words[k - 1].strip("\"'`")
                if key in _PAIRS and t.role.get(t.opener[k]) == "object" and (k < 2 or t.words[k - 2] in ("{", ",")) and k + 1 < len(t.words):
                    end = self._end(k + 1)
                    yield self._row("pair", key, k - 1, k + 1, end, ("", False, ""))
            elif kind == "op" and word == "=" and k and k + 1 < len(t.words):
                left = t.words[k - 1]
                if left in ("innerHTML", "outerHTML") and k > 1 and t.words[k - 2] in (".", "?.") or "NODE_TLS_REJECT_UNAUTHORIZED" in left or left == "]" and "NODE_TLS_REJECT_UNAUTHORIZED" in t.words[max(0, k - 2)]:
                    first = self.chain(k - 1)
                    end = self._end(k + 1)
                    yield self._row("assign", self.said(first, k), first, k + 1, end, self.value(k + 1, end))
                elif left == "dangerouslySetInnerHTML" and t.role.get(t.opener[k]) == "tag" and t.words[k + 1] == "{" and k + 1 in t.match:
                    inner, close = k + 2, t.match[k + 1]
                    if inner < close and t.words[inner] == "{" and inner in t.match:
                        yield self._row("jsx", left, k - 1, inner + 1, t.match[inner], ("", False, ""), close + 1)

    def _row(self, what: str, key: str, first: int, low: int, high: int, value: tuple, end: int | None = None) -> tuple:
        start, kept = self.t.starts[first], self.t.ends[(high if end is None else end) - 1]
        return (what, key.strip("\"'"), "", *self.place(start), self.source[start : min(kept, start + 400)], value[0], value[1], value[1], value[2], self.said(low, high).strip(), "", {}, False)


def rows_of(source: str) -> list[tuple]:
    reader = Reader(source)
    return [*reader.calls(), *reader.named()]


def _parsed(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in sources:
        made = []
        for source in some:
            try:
                made.append(([dict(zip(_FIELDS, r)) for r in rows_of(source)], False))
            except RecursionError:
                made.append(([], True))
        yield pd.DataFrame(made, columns=["rows", "failed"])


def parsed(files: DataFrame) -> DataFrame:
    """files with p: the rows, and whether the scan gave up."""
    parse = F.pandas_udf(_parsed, f"struct<rows:array<{ROW}>,failed:boolean>").asNondeterministic()  # or explode has it run a second time, to filter
    return files.withColumn("p", parse("text"))
