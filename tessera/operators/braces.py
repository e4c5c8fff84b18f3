"""Facts of source in languages with braces, read by line and bracket: definitions, imports, bases and calls.

There is no parser for these languages here, so strings and comments are
blanked, headers are found by pattern, and a body ends where its brace closes.
What cannot be seen that way (macros, types of receivers, headers over several
lines) is left out. Rows are those of `program.FACTS`.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Language(NamedTuple):
    """Patterns of one language; a function's first two groups are its name and parameters, a class's its name and bases."""

    functions: tuple[str, ...]
    classes: tuple[str, ...]
    imports: tuple[str, ...]
    methods: tuple[str, ...] = ()
    receiver: str = ""
    comment: str = r"//[^\n]*|/\*.*?\*/"
    string: str = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|open|suspend|inline|export|default|readonly|partial|extern|unsafe|const|mutating|synchronized|fileprivate)\s+)*"
_ECMA = Language(
    functions=(rf"^\s*{_MODS}function\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>"),
    classes=(rf"^\s*{_MODS}(?:class|interface)\s+(\w+)(?:<[^>]*>)?(?:\s+(?:extends|implements)\s+([\w.,\s]+))?",),
    imports=(r"""^\s*import\b[^'"]*['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    methods=(rf"^\s*{_MODS}(?:get\s+|set\s+)?(#?\w+)\s*(?:<[^>]*>)?\(([^)]*)\)\s*(?::[^{{;]+)?\{{",),
    string=r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`',
)
_C = Language(
    functions=(r"^(?!\s*(?:else|return|typedef|new|throw|case|goto)\b)[\w\s*&:<>,~]*?[\w*&>]\s+[*&]*((?:\w+::)*~?\w+)\s*\(([^;{]*?)\)\s*(?:const\s*)?(?:noexcept\s*)?(?=\{|$)",),
    classes=(r"^\s*(?:typedef\s+)?(?:class|struct|union)\s+(\w+)(?:\s*:\s*([\w:,<>\s]+))?\s*(?=\{|$)",),
    imports=(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]',),
)
LANGUAGES = {
    "javascript": _ECMA,
    "typescript": _ECMA,
    "go": Language((r"^\s*func\s+(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)\)",), (r"^\s*type\s+(\w+)\s+(?:struct|interface)\b()",), (r'^\s*(?:import\s+)?(?:\w+\s+|_\s+|\.\s+)?"([\w./-]+)"\s*$',), receiver=r"^\s*func\s+\(\s*\w*\s*\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*(\w+)\s*\(([^)]*)\)", string=r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.)+\''),
    "rust": Language((r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)",), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)(?:<[^>]*>)?(?:\s*:\s*([\w+\s:]+))?", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)()"), (r"^\s*(?:pub\s+)?use\s+([\w:]+)",), string=r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\\n]|\\.)\''),
    "java": Language((), (rf"^\s*{_MODS}(?:class|interface|enum|record)\s+(\w+)(?:<[^>]*>)?(?:\([^)]*\))?(?:\s+(?:extends|implements)\s+([\w.,<>\s]+))?",), (r"^\s*import\s+(?:static\s+)?([\w.]+)",), (rf"^\s*{_MODS}(?:<[^>]*>\s*)?(?:[\w.<>\[\],?]+\s+)?(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\{{",)),
    "kotlin": Language((rf"^\s*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(([^)]*)\)",), (rf"^\s*{_MODS}(?:data\s+|enum\s+)?(?:class|interface|object)\s+(\w+)(?:<[^>]*>)?(?:\([^)]*\))?(?:\s*:\s*([\w.,()<>\s]+))?",), (r"^\s*import\s+([\w.]+)",)),
    "swift": Language((rf"^\s*{_MODS}func\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)", rf"^\s*{_MODS}(init)\s*\(([^)]*)\)"), (rf"^\s*{_MODS}(?:class|struct|enum|protocol|extension)\s+(\w+)(?:<[^>]*>)?(?:\s*:\s*([\w.,\s]+))?",), (r"^\s*import\s+([\w.]+)",)),
    "csharp": Language((), (rf"^\s*{_MODS}(?:class|interface|struct|enum|record)\s+(\w+)(?:<[^>]*>)?(?:\s*:\s*([\w.,<>\s]+))?",), (r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",), (rf"^\s*{_MODS}(?:[\w.<>\[\],?]+\s+)?(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)\s*(?:where[^{{]+)?(?:\{{|$)",)),
    "scala": Language((rf"^\s*{_MODS}def\s+(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)\)",), (rf"^\s*{_MODS}(?:case\s+)?(?:class|trait|object)\s+(\w+)(?:\[[^\]]*\])?(?:\([^)]*\))?(?:\s+extends\s+([\w.\s]+))?",), (r"^\s*import\s+([\w.]+)",)),
    "php": Language((rf"^\s*{_MODS}function\s+&?(\w+)\s*\(([^)]*)\)",), (rf"^\s*{_MODS}(?:class|interface|trait)\s+(\w+)(?:\s+(?:extends|implements)\s+([\w\\,\s]+))?",), (r"^\s*use\s+([\w\\]+)", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]"""), comment=r"//[^\n]*|#[^\n]*|/\*.*?\*/"),
    "c": _C,
    "cpp": _C,
}
DECISIONS = re.compile(r"\b(if|for|while|case|catch|foreach|guard|when)\b|&&|\|\||\?(?![.?:>])")
NESTERS = re.compile(r"\b(if|for|while|switch|catch|foreach|match|guard|when)\b")
CALL = re.compile(r"([A-Za-z_$]\w*(?:(?:\.|::|->|\?\.)[A-Za-z_$]\w*)*)\s*(?:::<[^>]*>)?\(")
CONTROL = re.compile(r"\b(if|else|for|while|switch|catch|foreach|match|guard|when|try|do|finally|loop|select)\b")
NOT_CALLED = frozenset("import if for while switch catch return function func fn sizeof typeof new await match when guard foreach do else throw super defer go case in and or not using lock synchronized".split())


def masked(content: str, lang: Language) -> str:
    """The text with comments and strings as blanks, line breaks kept."""
    both = re.compile(rf"({lang.comment})|({lang.string})", re.S)
    return both.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)) if m.group(1) else m.group(0)[0] + re.sub(r"[^\n]", " ", m.group(0)[1:-1]) + m.group(0)[-1:], content)


def file_facts(path: str, content: str, language: str) -> list[tuple]:
    """Rows of program.FACTS for one file: function, method, class, base, import, call."""
    lang = LANGUAGES[language]
    plain = masked(content, lang)
    raw = content.split("\n")
    out: list[tuple] = []
    stack: list[dict] = []
    pending: dict | None = None
    depth = 0
    #: Of each open brace, whether a control structure opened it; and the text since the last brace or semicolon.
    control: list[bool] = []
    since = ""

    def row(kind, name, owner, detail, line, end=None, numbers=(None,) * 4):
        out.append((path, kind, name, owner, detail, line, end, *numbers))

    def owner() -> str | None:
        return next((s["name"] for s in reversed(stack) if s["kind"] != "class"), None)

    def close(s: dict, end: int) -> None:
        if s["kind"] == "class":
            if s["new"]:
                row("class", s["name"], None, None, s["line"], end)
            return
        body = s["body"]
        complexity = 1 + sum(len(DECISIONS.findall(x)) for x, _ in body)
        cognitive = sum(1 + max(0, d - s["depth"] - 1) for x, d in body for _ in NESTERS.findall(x)) + sum(len(re.findall(r"\belse\b(?!\s*if)", x)) for x, _ in body)
        row(s["kind"], s["name"], s["owner"], s["detail"], s["line"], end, (s["params"], complexity, cognitive, s["nest"]))

    known: set[str] = set()
    for no, line in enumerate(plain.split("\n"), 1):
        for p in lang.imports:
            m = re.search(p, raw[no - 1]) if line.strip() else None
            if m:
                row("import", m.group(1), None, None, no)
        cls = next((s["name"] for s in reversed(stack) if s["kind"] == "class"), None)
        header = None
        m = next((m for p in lang.classes if (m := re.match(p, line))), None)
        if m:
            new = m.group(1) not in known
            known.add(m.group(1))
            header = {"kind": "class", "name": m.group(1), "line": no, "new": new}
            for b in re.split(r"[,+]|\bimplements\b|\bwith\b", m.group(2) or "") if new else ():
                if b.strip():
                    row("base", re.sub(r"<.*|\(.*|^(?:public|private|protected)\s+", "", b.strip()), m.group(1), None, no)
        elif lang.receiver and (m := re.match(lang.receiver, line)):
            header = {"kind": "method", "name": f"{m.group(1)}.{m.group(2)}", "owner": m.group(1), "args": m.group(3)}
        elif m := next((m for p in [*lang.functions, *(lang.methods if cls and not owner() else ())] if (m := re.match(p, line))), None):
            if m.group(1) not in NOT_CALLED:
                inside = owner() or cls
                method = cls is not None and owner() is None
                name = m.group(1).replace("::", ".")
                header = {"kind": "method" if method or "." in name else "function", "name": f"{inside}.{name}" if inside else name, "owner": inside, "args": m.group(2)}
        if header and header["kind"] != "class":
            args = [a.strip() for a in re.sub(r"<[^<>]*>", "", header.pop("args")).split(",")]
            args = [a for a in args if a and a not in ("void", "self", "&self", "&mut self", "mut self")]
            header |= {"detail": f"({', '.join(args)})", "params": len(args), "line": no, "body": []}
        if header:
            pending = header
        inner = owner()
        for m in CALL.finditer(line):
            if cls and inner is None and header is None and "=" not in line:
                continue  # a declaration without a body
            opens = line.find("{") if "{" in line else len(line)
            if m.group(1).split(".")[-1] not in NOT_CALLED and not (header and header["kind"] != "class" and m.start() < opens):
                called = re.sub(r"::|->|\?\.", ".", m.group(1))
                row("call", called, inner or (header["name"] if header and "{" in line[: m.start()] and header["kind"] != "class" else None), None, no)
        shown = line
        since += " "
        for k, ch in enumerate(line):
            since = "" if ch == ";" else since + ch
            if ch == "{":
                control.append(not pending and bool(CONTROL.search(since)))
                since = ""
                if pending:
                    stack.append(pending | {"depth": depth, "opened": len(control), "nest": 0})
                    pending, shown = None, line[k + 1 :]
                elif fn := next((s for s in reversed(stack) if s["kind"] != "class"), None):
                    fn["nest"] = max(fn["nest"], sum(control[fn["opened"] :]))
                depth += 1
            elif ch == "}":
                since = ""
                depth -= 1
                control = control[:-1]
                if stack and stack[-1]["depth"] == depth:
                    top = stack.pop()
                    if top["kind"] != "class":
                        top["body"].append((line[:k] if top["line"] != no else shown[: max(0, k - (len(line) - len(shown)))], depth + 1))
                    close(top, no)
                    shown = line[k + 1 :]
            elif ch == ";" and pending:
                if pending["kind"] == "class" and pending["new"]:
                    row("class", pending["name"], None, None, pending["line"], no)
                pending = None
        for s in stack:
            if s["kind"] != "class" and s is stack[-1]:
                s["body"].append((shown, depth - (shown.count("{") if shown is line else 0)))
    for s in reversed(stack):
        close(s, len(raw))
    return out
