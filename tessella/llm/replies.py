"""How replies to prompts are built and how they end: wrapping, content, and whether the writer got to the end.

``read`` takes a reply apart: marks of a cut, code fences, a JSON object (also malformed) or prose, and the content under
the object's first key. ``ending`` judges it: COMPLETE, CUT (an open structure, a mark, a broken escape or character, a
list entry that is the beginning of a word), or OPEN where only the last words can tell; these are returned generalised
(quoted words, numbers and the label replaced), so that they can be looked up among the ends of finished sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

COMPLETE, CUT, OPEN = 0, 1, 2

# Bracketed marks that storage or transfer leaves after a cut; dots and replacement characters are others.
_MARK = re.compile(
    r"""[\[<(] \s* (?: \.{3} | … | [^\[\]()<>{}]{0,24}? (?:truncat|clip|cut|omitted|shorten|abbreviat)[^\[\]()<>{}]{0,16} | \+?\s*\d+\s*(?:more\s*)?(?:char|byte|word|token)\w* (?:\s\w+)? | more ) \s* [\])>]""",
    re.X | re.I,
)
_FENCE_START = re.compile(r"^\s*```[\w+-]*[ \t]*(?:\r?\n|$)")
_FENCE_END = re.compile(r"\s*```\s*$")
_BOLD = re.compile(r"^\s*\*\*[^*\n]{1,40}\*\*\s*")
_KEY = re.compile(r"""[{,]\s*["'“]?\s*([A-Za-z_][\w -]{0,40})["'”]?\s*:\s*""")
_NEXT_KEY = re.compile(r"""["']\s*,\s*["'][A-Za-z_][\w -]{0,40}["']\s*:[^:{}]*\}?[^{}]*$""", re.S)
_CHAIN = re.compile(r"\s>(?:\s|$)")
_QUOTED = re.compile(r"""\\?["«„“‘'](?=\S|\s\S)[^"»“”’'\\«„\n]{1,40}\\?["»“”’'](?!\w)""")
_STOP = re.compile(r"""[.!?。！？](?:\\?["'»”’)\]]|\s)*$""")
_WORD = re.compile(r"[^\W_]+(?:['’/-][^\W_]+)*")
_TOKEN = re.compile(r"\w+(?:['’/-]\w+)*|[^\w\s]")
_ITEM = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•])[ \t]*")
_CLOSERS = re.compile(r"""["'”]?\s*,?\s*[\]}]+\s*(?:```)?$""")
_LIST_HEAD = re.compile(r"^[^\n:>]{0,40}:\s*")
# What stands in for an answer that isn't there.
NOTHING = frozenset({"", "null", "none", "nan", "n/a", "na", "nil", "undefined", "-", "--", "—", "?", ".", "...", "{}", "[]", '""', "''"})


@dataclass(slots=True)
class Reply:
    core: str
    marked: bool
    is_json: bool
    closed: bool
    key: str
    content: str
    fenced: bool
    end: int


def _unescape(s: str) -> str:
    return s.replace("\\n", "\n").replace('\\"', '"').replace("\\'", "'").replace("\\t", " ") if "\\" in s else s


def mark_of(core: str) -> int | None:
    """Where the mark of a cut at the end of a value starts, None without one."""
    last = core[-1:]
    if last == "\ufffd":
        return len(core.rstrip("\ufffd"))
    if last == "…":
        return len(core) - 1
    if core.endswith("..."):
        return len(core) - 3
    if last and last in "])>":
        at = max(core.rfind("["), core.rfind("<"), core.rfind("("))
        if at >= 0 and _MARK.fullmatch(core, at):
            before = core[:at].rstrip()
            for dots in ("...", "…"):
                if before.endswith(dots):
                    return len(before) - len(dots)
            return at - 1 if at and core[at - 1].isspace() else at
    return None


def read(value: str) -> Reply:
    core = value.rstrip()
    mark = mark_of(core)
    end = len(value.rstrip("\r\n")) if mark is None else mark
    if mark is not None:
        core = core[:mark].rstrip()
    broken = (len(core) - len(core.rstrip("\\"))) % 2 == 1
    inner = core
    start = _FENCE_START.match(inner)
    fenced = start is not None
    if start is not None:
        inner = inner[start.end() :]
    if inner.endswith("```"):
        inner = _FENCE_END.sub("", inner)
    at = inner.find("{")
    if at >= 0:
        body = inner[at:]
        closed = body.count("{") <= body.count("}") and body.count("[") <= body.count("]")
        if closed and mark is None and (tail := _CLOSERS.search(core, max(0, len(core.rstrip("`]}\"'”, \t\r\n")) - 1))) is not None:
            end = tail.start()
        key = _KEY.match(body)
        content = body[key.end() :] if key else body[1:]
        if closed:
            more, brace = _NEXT_KEY.search(content), content.rfind("}")
            if more is not None:
                content = content[: more.start()]
            elif brace >= 0:
                content = content[:brace].rstrip().removesuffix(",")
        content = content.strip()
        if content[:1] in ("'", '"', "“"):
            quote = content[0]
            content = content[1:]
            if content.endswith(quote) and not content.endswith("\\" + quote):
                content = content[:-1]
        return Reply(core, mark is not None or broken, True, closed, key.group(1).strip().lower() if key else "", _unescape(content).strip(), fenced, end)
    content = _BOLD.sub("", inner).strip()
    if len(content) > 1 and content[0] == content[-1] == '"':
        content = content[1:-1].strip()
    return Reply(core, mark is not None or broken, False, not broken, "", content, fenced, end)


def plain(text: str | None) -> str:
    """Letters and digits only, case folded."""
    return "".join(_WORD.findall((text or "").casefold())).replace("'", "").replace("’", "").replace("/", "").replace("-", "")


def general_tokens(content: str, label: str | None) -> list[str]:
    """Tokens of a content in lower case, quoted words as Q, numbers as N, the label as L."""
    flat = _QUOTED.sub(" Q ", content)
    if label:
        flat = _label(label).sub("L", flat)
    return [("N" if t[0].isdigit() else t if t in ("Q", "L") else t.lower()) for t in _TOKEN.findall(flat)]


@lru_cache(maxsize=1000)
def _label(label: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![\w/]){re.escape(label)}(?![\w/])", re.I)


def words_at(tokens: list[str], i: int) -> str:
    """The three tokens before position i."""
    return " ".join(tokens[max(0, i - 3) : i])


def is_nothing(reply: Reply) -> bool:
    c = reply.content.strip().strip("\"'`{}[]:, \n").casefold()
    return c in NOTHING


def _entry(content: str) -> tuple[bool, str] | None:
    """(another entry was begun, last entry) of a list in prose; None if it isn't one."""
    if _CHAIN.search(content):
        parts = [p.strip() for p in _LIST_HEAD.sub("", content).split(">")]
        return parts[-1] == "", parts[-1]
    parts = [p.strip() for p in _ITEM.split(content)]
    if len(parts) > 1 and len(parts[-1].split()) <= 3:
        return parts[-1] == "" or bool(re.search(r"\n\s*\d{1,3}$", content)), parts[-1].split("\n")[0]
    return None


def ending(reply: Reply, text: str | None, prompt: str | None, label: str | None) -> tuple[int, list[str]]:
    """(verdict, general tokens of a sentence or the last entry of a list where the last words can tell); finished ones, too."""
    if reply.marked and not (reply.is_json and reply.closed):
        return CUT, []
    if reply.is_json and not reply.closed:
        return CUT, []
    if is_nothing(reply):
        begun = not reply.is_json and reply.fenced and not reply.core.endswith("```")
        return (CUT if begun else COMPLETE), []
    content = reply.content
    if reply.is_json and reply.key in ("salience", "ranking"):
        items = re.findall(r"""["']((?:[^"'\\]|\\.)+)["']\s*\]?\s*$""", content)
        return COMPLETE, [f"item {items[-1].casefold()}"] if items else []
    if not reply.is_json and (entry := _entry(content)) is not None:
        begun, last = entry
        if begun:
            return CUT, []
        words = {w.strip(".,;:!?\"()").casefold() for w in (text or "").split()} | {w.casefold() for w in _WORD.findall(text or "")}
        item = last.casefold()
        if item in words:
            return COMPLETE, []
        if any(w.startswith(item) for w in words):
            return CUT, []
        return OPEN, [f"item {item}"]
    if _STOP.search(content):
        return COMPLETE, general_tokens(_STOP.sub("", content), label)
    if content[-1:] in (",", ";", ":", "(", "«", "„"):
        return CUT, []
    if not re.search(r"[^\W\d_]", content):
        return COMPLETE, []
    if reply.is_json and reply.key == "rewritten":
        return COMPLETE, []
    own = plain(content)
    if own and text and plain(text).endswith(own):
        return COMPLETE, []
    if prompt and content in prompt:
        after = prompt[prompt.find(content) + len(content) :][:1]
        if not after.isalnum():
            return COMPLETE, []
    return OPEN, general_tokens(content, label)
