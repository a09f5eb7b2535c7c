"""Rule patterns as data, for Java's regex engine and, for checks, in RE2's dialect.

Patterns are written once with ``\\b``, ``\\w`` and ``\\s`` in the Unicode sense. `java`
marks them so; `re2` spells the classes out and turns word boundaries into groups, which
serves for tests and for extraction of group 1.
"""

from __future__ import annotations

# The rules' patterns, in the order in which they are tried.
IDEA_RULES = [
    ("definition", 0.8, [r"\bis\s+(?:a|an|the)\s+\w", r"\bmeans?\s+", r"\bdefined\s+as\b", r"\brefers?\s+to\b", r"\b(?:is|are)\s+known\s+as\b", r"\bwhat\s+(?:is|are)\s+\w+\s+(?:is|are)\b"]),
    ("warning", 0.8, [r"\bbe\s+careful\b", r"\b(?:avoid|avoiding)\b", r"\bdo\s+not\b", r"\bdon't\b", r"\berror\b", r"\bfails?\b", r"\bproblem\b", r"\bwarning\b", r"\bcaution\b", r"\bincorrect\b", r"\bwrong\b", r"\bmistake\b", r"\b(?:make\s+)?sure\s+(?:you\s+)?(?:don't|do\s+not|avoid)\b"]),
    ("step", 0.7, [r"\bfirst(?:ly)?,", r"\bsecond(?:ly)?,", r"\bthird(?:ly)?,", r"\bnext,", r"\bthen\b", r"\bfinally,", r"\bclick\b", r"\brun\b", r"\binstall\b", r"\bcreate\b", r"\bopen\b", r"\bstart\b", r"\bchoose\b", r"\bselect\b", r"\btype\b", r"\bpress\b", r"\bstep\s+\d+\b"]),
    ("example", 0.7, [r"\bfor\s+example\b", r"\be\.g\.", r"\bsuch\s+as\b", r"\blike\b", r"\bfor\s+instance\b", r"\bexample\b"]),
    ("comparison", 0.7, [r"\bversus\b", r"\bvs\.?\b", r"\bcompared?\s+to\b", r"\bbetter\s+than\b", r"\bworse\s+than\b", r"\bsimilar\s+to\b", r"\bdifferent\s+from\b", r"\binstead\s+of\b", r"\brather\s+than\b", r"\bon\s+the\s+(?:one|other)\s+hand\b", r"\b(?:more|less)\s+\w+\s+than\b"]),
]
IDEA_FALLBACK = ("claim", 0.5)

CLAIM_RULES = [
    ("definition", 0.8, [r"\bis\s+(?:a|an|the)\s+", r"\b(?:means|refers to|defined as|is called|is known as)\b"]),
    ("warning", 0.8, [r"\b(?:careful|caution|warning|avoid|do not|dont|never|be careful|watch out|beware)\b"]),
    ("recommendation", 0.8, [r"\b(?:recommend|should|best practice|suggest|ideally|prefer|use this|try using)\b"]),
    ("comparison", 0.7, [r"\b(?:compare|comparison|versus|vs|unlike|whereas|on the other hand|better|worse|faster|slower)\b"]),
    ("error_solution", 0.7, [r"\b(?:error|bug|fix|solution|resolve|workaround|patch|hotfix|debug)\b"]),
    ("step", 0.65, [r"\b(?:first|then|next|after that|finally|step|install|run|create|build|set up|configure)\b"]),
    ("limitation", 0.65, [r"\b(?:limitation|drawback|downside|caveat|however|but |issue|problem|challenge|difficulty|complexity)\b"]),
]
CLAIM_FALLBACK = ("factual", 0.5)
NEGATIVE = ("do not ", "dont ", "never ", "avoid ", "stop ")
POSITIVE = ("do ", "always ", "use ", "recommend ")

FILE_PATHS = [
    r"(?:/[a-zA-Z0-9_.-]+)+(?:\.[a-zA-Z0-9]+)?",
    r"[a-zA-Z0-9_]+/[a-zA-Z0-9_/]+(?:\.[a-zA-Z0-9]+)?",
    r"\b(?:src|lib|bin|etc|usr|home|var|tmp|opt|app|dist|build|node_modules|packages)\b[/\\][a-zA-Z0-9_./\\-]+",
]
CODE_IDENTIFIERS = [
    r"\b(?:function|class|def|var|let|const|import|export|return|async|await)\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"([a-z][a-z0-9]*(?:_[a-z0-9]+)+)",
    r"([a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+)",
    r"(?:[A-Z][a-z0-9]*){2,}",
    r"\b(?:npm|pip|git|docker|kubectl|yarn|npx|uvicorn|gunicorn|conda)\s+\S+",
]
IMPORTS = [r"(?:from|import)\s+([a-zA-Z_][a-zA-Z0-9_.]*)", r"require\(['\"]([a-zA-Z_][a-zA-Z0-9_./]*)"]
COMMANDS = [
    r"(?:npm|npx|yarn|pnpm)\s+(?:run|install|add|build|test|start|dev|lint|exec)\s*\S*",
    r"pip\s+(?:install|uninstall|list|show|freeze|download)\s*\S*",
    r"python\d?\s+(?:-m\s+\S+|script\.py|\S+\.py)",
    r"git\s+(?:clone|commit|push|pull|add|checkout|branch|merge|rebase|log|status|diff|stash|tag|init|remote)",
    r"uvicorn\s+\S+:\S+(?:\s+--reload)?",
    r"gunicorn\s+\S+:\S+",
    r"docker\s+(?:run|build|compose|ps|exec|logs|pull|push|stop|rm|images)",
    r"kubectl\s+\S+",
    r"conda\s+(?:install|create|activate|deactivate|env|list)",
    r"curl\s+[-/\w.:]+\s*\S*",
    r"wget\s+\S+",
    r"make\s+\S*",
    r"echo\s+[\"']?[^\"']+[\"']?",
    r"cat\s+[/\w.\-]+\S*",
    r"grep\s+[-rni]+\s+\S+",
    r"chmod\s+\d+\s+\S+",
    r"ssh\s+\S+@\S+",
    r"scp\s+\S+\s+\S+",
    r"sudo\s+\S+",
    r"\./[\w./-]+",
]
ERRORS = [
    r"(?:Error|ERROR|error)[:\s]+.*",
    r"(?:Traceback|traceback)[:\s]+.*",
    r"(?:Cannot find module|Module not found|No module named)\s+\S+",
    r"(?:Permission denied|command not found|segmentation fault|core dumped)",
    r"(?:SyntaxError|TypeError|ValueError|KeyError|IndexError|AttributeError|ImportError|RuntimeError|FileNotFoundError|ZeroDivisionError)",
    r"(?:FAILED|failed|FAILURE|failure)[:\s].*",
    r"(?:exit code|returned non-zero|exited with)\s+\d+",
    r"(?:404|403|500|502|503)\s+(?:Not Found|Forbidden|Error)",
    r"(?:Could not|Cannot|Unable to)\s+\w+",
    r"(?:timeout|timed out|Timed out|Timeout)",
    r"(?:warning|WARNING|Warning)[:\s]+.*deprecat",
    r"(?:panic|PANIC)[:\s].*",
    r"(?:AssertionError|assert\s+.*failed)",
]
EQUATIONS = [
    r"[A-Za-z]\s*=\s*[A-Za-z][A-Za-z0-9]*(?:\^-\d+)?(?:\s*[+\-*/]\s*[A-Za-z0-9]+)*",
    r"det\s*\([^)]+\)",
    r"[A-Za-z]+\^T\s*[A-Za-z]",
    r"(?:\b|(?<=\s))(?:sum|integral|limit|log|exp|sqrt|sin|cos|tan)\s*\([^)]+\)",
    r"(?:\b|(?<=\s))lambda\s*\s*[A-Za-z0-9]+",
    r"(?:\b|(?<=\s))[A-Za-z]\s*=\s*PDP\^-1",
    r"Ax\s*=\s*b",
    r"(?:\b|(?<=\s))[A-Za-z]\s*=\s*[A-Za-z]+\s*[+\-*/]\s*[A-Za-z]+",
    r"(?:\b|(?<=\s))\d+\.?\d*\s*[+\-*/]\s*\d+\.?\d*\s*=\s*\d+\.?\d*",
    r"\\\(.*?\\\)",
    r"\\\[.*?\\\]",
]

# What a text must hold for a pattern to be found in it: a string of each group. Searching for strings
# costs a small part of trying the pattern at every place. In lower case where the pattern ignores it.
FILE_PATHS_NEED = [(("/",),), (("/",),), (("/", "\\"),)]
CODE_IDENTIFIERS_NEED = [
    (("function", "class", "def", "var", "let", "const", "import", "export", "return", "async", "await"),), (("_",),), (), (), (("npm", "pip", "git", "docker", "kubectl", "yarn", "npx", "uvicorn", "gunicorn", "conda"),),
]
#: Two characters that stand in every match of these patterns: found in one pass, where the patterns go over each word again from each of its letters.
CODE_IDENTIFIERS_SIGN = {2: "[a-z0-9][A-Z]", 3: "[A-Za-z0-9][A-Z]"}
IMPORTS_NEED = [(("from", "import"),), (("require(",),)]
COMMANDS_NEED = [
    (("npm", "npx", "yarn"),), *(((w,),) for w in ("pip", "python", "git", "uvicorn", "gunicorn", "docker", "kubectl", "conda", "curl", "wget", "make", "echo", "cat", "grep", "chmod", "ssh", "scp", "sudo", "./")),
]
ERRORS_NEED = [
    (("error",),), (("traceback",),), (("cannot find module", "module not found", "no module named"),), (("permission denied", "command not found", "segmentation fault", "core dumped"),), (("error",),), (("fail",),),
    (("exit code", "returned non-zero", "exited with"),), (("404", "403", "500", "502", "503"), ("not found", "forbidden", "error")), (("could not", "cannot", "unable to"),), (("timeout", "timed out"),),
    (("warning",), ("deprecat",)), (("panic",),), (("assert",),),
]
EQUATIONS_NEED = [
    (("=",),), (("det",), ("(",)), (("^T",),), (("sum", "integral", "limit", "log", "exp", "sqrt", "sin", "cos", "tan"), ("(",)), (("lambda",),), (("PDP^-1",),), (("Ax",), ("=",)), (("=",),), (("=",),), (("\\(",),), (("\\[",),),
]
#: A string that the patterns of a class of ideas need; none of it, none of them.
IDEA_NEED = {
    "definition": ("is", "mean", "defined", "refer", "known", "what"),
    "warning": ("careful", "avoid", "not", "don't", "error", "fail", "problem", "warning", "caution", "incorrect", "wrong", "mistake"),
    "step": ("first", "second", "third", "next", "then", "finally", "click", "run", "install", "create", "open", "start", "choose", "select", "type", "press", "step"),
    "example": ("example", "e.g.", "such", "like", "instance"),
    "comparison": ("versus", "vs", "compare", "better", "worse", "similar", "different", "instead", "rather", "hand", "than"),
}
CLAIM_NEED = {
    "definition": ("is", "means", "refers to", "defined as"),
    "warning": ("careful", "caution", "warning", "avoid", "do not", "dont", "never", "watch out", "beware"),
    "recommendation": ("recommend", "should", "best practice", "suggest", "ideally", "prefer", "use this", "try using"),
    "comparison": ("compar", "versus", "vs", "unlike", "whereas", "on the other hand", "better", "worse", "faster", "slower"),
    "error_solution": ("error", "bug", "fix", "solution", "resolve", "workaround", "patch"),
    "step": ("first", "then", "next", "after that", "finally", "step", "install", "run", "create", "build", "set up", "configure"),
    "limitation": ("limitation", "drawback", "downside", "caveat", "however", "but ", "issue", "problem", "challenge", "difficulty", "complexity"),
}
#: Letters that patterns without regard to case take for i, k and s, and that lower case leaves as others.
CASE_FROM, CASE_TO = "\u0130\u0131\u017f\u212a", "iisk"

CAPITALIZED = r"[A-Z][a-zA-Z]*\s[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)*"
ACRONYMS = r"\b[A-Z]{2,6}\b"
ENTITY_PATHS = r"(?:/[a-zA-Z0-9_.-]+)+(?:\.[a-zA-Z0-9]+)?"
ENTITY_CODE = [r"\b[A-Z][a-zA-Z0-9]*\([^)]*\)", r"\b[a-z][a-zA-Z0-9]*\.[a-z][a-zA-Z0-9]+", r"[a-z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+"]
KNOWN_TERMS = (
    "Playwright", "Selenium", "Tesseract", "Whisper", "SQLite", "FTS5", "MCP", "API", "OCR", "ASR", "REST", "JSON", "HTML", "CSS", "HTTP",
    "RNN", "LSTM", "CNN", "BERT", "GPT", "LLM", "MMR", "Transformer", "Attention", "Positional Encoding", "YouTube", "pytest", "npm", "node",
)
PACKAGES = ("playwright", "pytesseract", "yt-dlp", "ffmpeg", "pydantic", "typer")

STALE = ("deprecated", "deprecation", "outdated", "legacy", "old version", "no longer supported", "replaced by", "superseded", "obsolete", "not recommended", "you should not use", "avoid using")
FRESH = ("new", "latest", "updated", "modern", "current", "recent", "new version", "v2", "v3", "next gen", "next-generation")
TOOLS = ("api", "sdk", "library", "package", "module", "framework", "tool", "language", "version", "release", "npm", "pip")

NOVEL_WARNING = ("warning", "careful", "avoid", "error", "fail", "problem", "caution", "incorrect", "wrong", "mistake", "dont", "not")
NOVEL_EXAMPLE = ("example", "instance", "sample", "demo", "illustrate")
NOVEL_COMPARISON = ("versus", "compared", "better", "worse", "similar", "different", "instead", "rather", "faster", "slower")
NOVEL_CODE = ("install", "config", "setup", "import", "export", "return", "class", "function", "method", "define", "create", "build", "run", "cmd", "npm", "pip")

HIT_PHRASES = {
    "warning": ("careful", "caution", "warning", "avoid", "be careful", "do not", "dont", "never", "watch out"),
    "example": ("example", "for instance", "such as", "e.g.", "like", "scenario"),
    "comparison": ("compare", "comparison", "versus", "vs", "unlike", "whereas", "on the other hand"),
    "code_like": ("install", "run ", "npm", "pip", "git ", "import ", "function", "class "),
}


def java(pattern: str, ignore_case: bool = False) -> str:
    """Unicode classes; a dot stops at line feeds only."""
    return ("(?Uid)" if ignore_case else "(?Ud)") + pattern


def any_of(patterns: list[str]) -> str:
    """One pattern for all; a boundary that all begin with is tested once for each place."""
    if all(p.startswith(r"\b") for p in patterns):
        return r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"
    return "|".join(f"(?:{p})" for p in patterns)


_WORD, _SPACE, _NOT_SPACE = r"\p{L}\p{N}_", r"\s\p{Z}", r"[^\s\p{Z}]"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern without look-around: a boundary is the edge or one more character."""
    out = pattern.replace(r"(?:\b|(?<=\s))", rf"(?:^|[^{_WORD}])")
    if out.startswith(r"\b"):
        out = rf"(?:^|[^{_WORD}])" + out[2:]
    out = out.replace(r"\b", rf"(?:$|[^{_WORD}])")
    return ("(?i)" if ignore_case else "") + _spelled(out)


def _spelled(pattern: str) -> str:
    """Write classes out, outside and inside of brackets; the boundaries' own are so already."""
    long = {r"\S": _NOT_SPACE, r"\w": f"[{_WORD}]", r"\s": f"[{_SPACE}]"}
    out, inside, k = "", False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in long:
            full = long[two]
            out += full[1:-1] if inside and two != r"\S" else full
            k += 2
            continue
        if two[0] == "\\":
            out, k = out + two, k + 2
            continue
        inside = (two[0] == "[") or (inside and two[0] != "]")
        out, k = out + two[0], k + 1
    return out
