"""Template residue, filler, error messages and demands for scripts.

Placeholders: each delimiter pair has a grammar of its own (expressions with
filters, calls and strings in double braces, statements, field names, slots
that describe themselves). Messages: they are recognised by their form, a
subject that is a page or the like with a failing predicate, a status code with
its reason, a request to switch scripts on, where a line or clause begins, and
not inside narration. A hit is discounted where its surroundings show that the
text writes about such things: in a code block, in quotation marks, after a
word that introduces an example, before a word that explains it. A placeholder
in prose whose name also stands in one of the text's code blocks is that code's
subject and no residue; others count, however much code the text has.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the literals are then looked for one after another
    ahocorasick = None

# ---------------------------------------------------------------- placeholders

_IDENT = r"[A-Za-z][A-Za-z0-9]*(?:[_.\-][A-Za-z0-9]+)*"
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+)*"
#: What a form asks for; the last word of a slot in plain words.
_FIELD = r"(?:names?|dates?|address(?:es)?|e-?mail|number|title|city|company|organi[sz]ation|phone|amount|url|link|id|code|time|place|location|signature|department|country|zip|price)"
#: One grammar per delimiter; the name group is the placeholder's content.
_GRAMMARS = (
    r"\{\{\{?(?P<dbl>[^{}]+)\}\}\}?",
    r"\{%[-+]?(?P<stm>[^{}%]+)[-+]?%\}",
    r"<%[=#-]?(?P<asp>[^<>%]+)%>",
    r"<\?(?:=|php )(?P<php>[^<>?]+)\?>",
    rf"[$#]\{{ ?(?P<dol>{_IDENT}(?:\([^(){{}}]*\)|\[[^\[\]{{}}]*\])*(?:\|[^{{}}|]*)*) ?\}}",
    rf"\$\((?P<par>{_IDENT})\)",
    rf"@@(?P<ats>{_IDENT})@@",
    rf"(?<!\w)__(?P<und>{_IDENT})__(?!\w)",
    rf"%%(?P<pp>{_IDENT})%%",
    rf"(?<![\w%])%(?P<per>{_IDENT})%(?!\w)",
    rf"%[({{](?P<fmt>{_IDENT})[)}}][sdf]?",
    rf"\[\[ ?(?P<wik>{_IDENT}) ?\]\]",
    rf"<< ?(?P<ang>{_IDENT}) ?>>",
    rf"(?<![\w\\$#%{{}}_^])\{{(?P<one>{_IDENT})\}}(?!\}})",
    rf"[<\[](?:insert|your|enter|add|type|put|write) (?P<ins>{_NAME}) here[>\]]",
    rf"[<\[](?P<goes>{_NAME})[ _]goes[ _]here[>\]]",
    rf"[<\[](?:placeholder|insert|enter your|your):? ?(?P<plc>{_NAME})[>\]]",
    r"[<\[](?P<todo>(?:todo|tbd|fixme|xxx)\b[^<>\[\]]*)[>\]]",
    rf"[<\[](?P<sup>{_NAME} to be (?:supplied|added|completed|filled in|provided|confirmed|determined))[>\]]",
    rf"[<\[](?P<fld>(?:[A-Za-z][\w'’]*[ _\-])+{_FIELD})[>\]]",
)
PLACEHOLDERS = re.compile("|".join(_GRAMMARS), re.IGNORECASE)
#: An expression between double braces: names, strings, numbers, operators; a name has two letters.
_EXPRESSION = re.compile(r"[#/^&>!~*-]*(?:[\w$@]+|'[^']*'|\"[^\"]*\"|[.|(),:=<>!+*/\[\]-]|\s)+")
#: Names between double underscores that a programming language reserves (fixed values).
_RESERVED = frozenset(("all", "call", "class", "dict", "doc", "enter", "eq", "exit", "file", "get", "getitem", "init", "iter", "len", "main", "name", "new", "next", "repr", "set", "slots", "str"))


def _valid(m: re.Match) -> bool:
    """Whether a delimited hit is a placeholder by the rest of its grammar."""
    kind, body = m.lastgroup, m.group(m.lastgroup).strip()
    if kind == "dbl":
        return bool(re.search(r"[A-Za-z]{2}", body)) and _EXPRESSION.fullmatch(body) is not None
    if kind in ("stm", "asp", "php"):
        return bool(re.search(r"[A-Za-z]{2}", body))
    if kind == "und":
        return body.lower() not in _RESERVED
    if kind == "one":
        return len(body) > 2
    if kind == "fld":  # in plain words it is a slot only if written as a name of a field is
        words = re.split(r"[ _\-]", body)
        return m.group(0)[1:-1].isupper() or all(w[:1].isupper() for w in words) or words[0].lower() in ("your", "insert", "enter", "recipient", "customer")
    return True


# -------------------------------------------------------------------- messages

_THING = (
    r"(?:pages?|sites?|website|links?|urls?|address|server|files?|documents?|resources?|content|records?|entry|entries|views?|items?|articles?|app|application|service|request|viewer|database|gateway|host"
    r"|system|tree|posts?|accounts?|images?|videos?|connection|portal|products?|listing|concept|term|vocabulary)"
)
_REASON = (
    r"(?:(?:(?:page|file|url|resource|document|entry|record|site) )?not found|forbidden|unauthori[sz]ed|bad request|request time-?out|too many requests|(?:internal )?server error|bad gateway|service (?:temporarily )?unavailable"
    r"|gateway time-?out|method not allowed|not acceptable|conflict|gone|payment required|not implemented|page (?:introuvable|nicht gefunden|no encontrada))"
)
_SORRY = r"(?:(?:sorry|oops|whoops|uh-oh|hmm+|unfortunately|apologies|we(?: are|['’]re) sorry|notice|warning|error|status|message|http|code)\b[ ,.:!|–-]*(?:[45]\d\d\b[ ,.:!|–-]*)?(?:but )?)*"
_TAIL = (
    r"(?=\W*$|[.!?…:;)\]|\n\"”–—-]| -|,? (?:on this server|at (?:this|the) (?:time|moment)|right now|any ?(?:more|longer)|or (?:has|is|may|was|does|you)|and (?:may|has been|is no)|due to|because|temporarily|from (?:your|this)|to (?:your|this)"
    r"|in your|with your|here\b|please|try|if (?:you|the problem)|when you|you\b|while|\()| \(|, (?:please|try|check))"
)
_PREDICATE = (
    r"(?:(?:could|can|may) ?not be (?:found|located|loaded|displayed|shown|opened|reached|retrieved|accessed|rendered|processed|completed)|can['’]t be (?:found|loaded|displayed|shown|opened|reached|accessed)"
    r"|failed to (?:load|open|render|respond|start)|(?:does not|doesn['’]t|do not|no longer) exists?|(?:was|were|is|are) (?:not found|not available|not accessible|not responding|offline|down)|is(?:n['’]t| not) (?:available|accessible|working|responding)"
    r"|has (?:been )?(?:removed|moved|deleted|expired|renamed|suspended|disabled|timed out)(?: or (?:removed|moved|deleted|expired|renamed))?|is no longer available|is restricted to|took too long to"
    r"|(?:is|are) (?:temporarily |currently |momentarily )?(?:unavailable|under maintenance|out of service)|didn['’]t respond|did not respond|refused to connect|(?:timed out|was reset|was refused|was interrupted))"
)
#: Forms that begin a line or clause.
_ERROR_CLAUSES = re.compile(
    rf"{_SORRY}(?:"
    rf"(?:(?:the|this|that|your|our|requested) )?(?:[\w'’-]+ ){{0,4}}?{_THING}(?: (?:that )?you(?: are|['’]re| were)? (?:looking for|requested|trying to (?:reach|view|access|open)|tried to (?:reach|view|access|open)))? {_PREDICATE}(?:(?<=to) \w+(?: \w+)?)?{_TAIL}"
    rf"|(?:page|file|url|resource|site) not found{_TAIL}|(?:internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|request time-?out|too many requests){_TAIL}"
    rf"|(?:http )?error (?:code )?[45]\d\d{_TAIL}"
    rf"|access (?:is |was )?denied(?=\s*(?:[.!:;(\-–|]|$)|\s+[A-Z])|(?:you )?do(?:es)? not have (?:permission to|access to|the rights? to)\b|you are not (?:authori[sz]ed|allowed|permitted) to\b|permission denied{_TAIL}"
    rf"|your (?:session|login|link|token) has (?:expired|timed out)|(?:please )?(?:sign|log) in (?:again )?to (?:continue|view|access|see|proceed)\b"
    rf"|something (?:went|has gone) wrong\b|an? (?:[\w-]+ ){{0,2}}?error (?:has )?occurr?ed\b|we (?:are having|are experiencing|encountered|ran into) (?:[\w-]+ ){{0,2}}?(?:trouble|problems?|difficulties|errors?|issues?)\b"
    rf"|(?:we )?(?:could ?n[o'’]t|can ?n[o'’]t|can['’]t|were unable to|are unable to|unable to) (?:find|load|open|reach|display|connect to|retrieve|process) (?:the|this|that|your) (?:[\w'’-]+ ){{0,3}}?{_THING}(?: (?:that )?you(?:['’]re| are| were)? \w+(?: for)?)?{_TAIL}"
    rf"|(?:please )?try again (?:later|in \d+ (?:seconds?|minutes?|hours?))\b|please (?:try|check) (?:again|back)\b|checking your browser\b|verify(?:ing)? (?:that )?you are (?:a )?human\b|(?:please )?complete the captcha\b"
    rf"|(?:the )?connection (?:has )?(?:timed out|was reset|was refused)\b|too many requests\b|invalid request\s*:|bandwidth limit exceeded\b|(?:this|the) (?:site|page|service) is (?:down|closed) for maintenance\b"
    rf"|(?:acceso denegado|acc[eè]s (?:refus[eé]|interdit)|zugriff verweigert|page introuvable|p[aá]gina no encontrada|seite nicht gefunden|interner serverfehler|erreur interne du serveur|error interno del servidor)\b"
    rf"|(?:die|der|das|diese|dieser|dieses) (?:[\w-]+ ){{0,4}}?(?:wurde|konnte|kann|ist) (?:leider )?(?:nicht|derzeit nicht|zurzeit nicht) (?:gefunden|geladen|angezeigt|erreichbar|verf[uü]gbar)\b"
    rf"|(?:la|le|cette|ce|l['’]) ?(?:[\w-]+ ){{0,4}}?(?:est|n['’]est pas|n['’]a pas|n['’]existe) (?:[\w-]+ ){{0,2}}?(?:introuvable|indisponible|disponible|trouv[eé]e?)\b"
    rf"|no se (?:pudo|puede|ha podido) (?:encontrar|cargar|mostrar|abrir)\b|inicie sesi[oó]n para\b|connectez-vous pour\b|melden sie sich (?:erneut )?an\b|versuchen sie es (?:sp[aä]ter|erneut)\b"
    rf")",
    re.IGNORECASE,
)
#: Forms that stand for themselves wherever they are.
_ERROR_SIGNS = re.compile(
    rf"(?<![\w.$€£-])[45]\d\d(?: ?[:.\-–—|/]+ ?| )(?:error(?: ?[:.\-–—|]+ ?| ))?{_REASON}(?![\w-])"
    r"|\bfatal error: |\btraceback \(most recent call last\)|\btraceback: |\b[a-z]\w*(?:error|exception) in \w+ ?\(|\b[A-Za-z][\w.]*(?:Error|Exception): (?=\S)|\bcall to undefined (?:function|method)\b|\bundefined (?:index|variable|offset): "
    r"|\bdatabase connection failed\b|\bsqlstate\[|\bora-\d{5}\b|\bsegmentation fault\b|\bparameter \"?\w+\"? missing\b|\bsyntax error near\b|\bno se (?:pudo|puede|ha podido) (?:encontrar|cargar|mostrar|abrir) (?:[\w]+ )?(?:p[aá]gina|sitio|recurso|archivo|documento|contenido|registro)|\binicie sesi[oó]n para\b"
    r"|\bpage introuvable\b|\bp[aá]gina no encontrada\b|\bseite (?:wurde )?nicht gefunden\b|\binterner serverfehler\b|\bservice est (?:\w+ )?indisponible\b|\bat [\w.$]+\([\w$]+\.java:\d+\)",
    re.IGNORECASE,
)

_SCRIPT = r"(?:(?:client[- ]side|browser|active) )?(?:java ?script|js|scripts?|scripting)\b"
_ON = r"(?:re-?)?(?:enable|turn on|switch on|activate|unblock|allow)"
_OFF = r"(?:disabled|turned off|switched off|not enabled|not supported|blocked|off\b|required|needed|enabled|turned on|on\b)"
_ASK = r"(?:please,? |kindly |you (?:must|should|have to|(?:will |may )?need to) |(?:to|in order to) (?:continue|proceed|view [\w ]+?|use [\w ]+?),? |for (?:the|a) (?:best|full|better) experience,? )"
_SCRIPT_CLAUSES = re.compile(
    rf"{_SORRY}(?:it (?:appears|seems|looks like)(?: that)? )?(?:{_ASK}*{_ON} (?:cookies and |your |the )?{_SCRIPT}"
    rf"|you (?:must|should|need to|have to) have {_SCRIPT}|(?:[\w'’-]+ ){{0,6}}?(?:does not|doesn['’]t|do not|don['’]t|won['’]t|will not) (?:work|run|function|load) (?:properly |correctly )?without {_SCRIPT}"
    rf"|(?:your browser['’]?s? )?{_SCRIPT}(?: and cookies)? (?:(?:is|are)(?: currently| probably)?|seems? to be|appears? to be|may be|might be|must be|has been|have been|needs? to be|should be) {_OFF}"
    rf"|(?:this|the|our) (?:[\w'’-]+ ){{0,3}}?(?:viewer|pages?|site|website|app|browser|view|application|tool|portal|form|content) (?:requires?|needs?|depends on|relies on|will not work without|does not work without|works best with) {_SCRIPT}"
    rf"|(?:you )?(?:need|require) {_SCRIPT} (?:enabled |turned on |support )?(?:to|for|in order)\b|requires? {_SCRIPT}\s*[.!]"
    rf"|without {_SCRIPT},? (?:this|the|some|many|parts?|you)\b|(?:your|this) browser (?:is not supported|does not support|doesn['’]t support|has {_SCRIPT} |is (?:out ?dated|too old))|unsupported browser\b"
    rf"|(?:please )?enable cookies\b|(?:please )?turn them on in your browser\b"
    rf"|(?:bitte )?aktivieren sie (?:bitte )?{_SCRIPT}|(?:veuillez )?(?:activer|activez) {_SCRIPT}|(?:por favor,? )?(?:active|habilite) {_SCRIPT}|{_SCRIPT} (?:ist|est|est[aá]) (?:deaktiviert|erforderlich|d[eé]sactiv[eé]|requis|n[eé]cessaire|desactivado|deshabilitado|necesario)"
    rf")",
    re.IGNORECASE,
)
_SCRIPT_SIGNS = re.compile(
    rf"\b(?:please|kindly|you (?:must|need to|have to)|veuillez|bitte|por favor,?) (?:{_ON}|activer|active|aktivieren sie) (?:cookies and |your |the )?{_SCRIPT}|\bscripts and cookies must be\b|\bscripting turned off\b"
    rf"|\b{_ON} {_SCRIPT}(?=[^.;!?\n]*\b(?:to (?:view|use|see|run|continue)|and (?:reload|cookies)|reload|in your browser|in the settings|before you go on)\b)",
    re.IGNORECASE,
)

#: Words of the customary mock Latin (fixed values).
_LATIN = (
    r"(?:lorem|ipsum|dolor|sit|amet|consectetur|consectetuer|adipiscing|adipisicing|elit|sed|do|ut|et|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo"
    r"|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum)"
)
#: Walks along a row of keys.
_MASH = r"(?:asdf(?:g|gh|ghj|ghjk|ghjkl)?|sdfg|dfgh|fghj|ghjk|hjkl|jkl;|qwer(?:t|ty|tyu|tyui|tyuiop)?|rtyu|tyui|uiop|zxcv(?:b|bn|bnm)?|xcvb|cvbn)"
_FILLER_CLAUSES = re.compile(
    r"(?:this is (?:a |an |some |only )?(?:sample|placeholder|dummy|filler|example) (?:text|paragraph|page|post|content|copy)\b|(?:dummy|placeholder|filler|sample) (?:paragraph|text|content|copy|headline)(?= for\b|[.!:]|\s*$|\n)"
    r"|(?:more |the )?(?:content|text|description|page|site|details) (?:is |are )?coming soon(?= *(?:[.!…]|$|\n))|coming soon(?= *(?:[.!…]|$|\n))|(?:this )?(?:page|site|section) (?:is )?(?:currently |still )?under construction\b"
    r"|(?:your|the) (?:[\w-]+ ){0,2}?(?:goes|go) here\b|your (?:[\w-]+ )?(?:text|content|title|heading|description|name|caption) here\b|replace (?:it|this|me)(?: \w+)? with (?:the|your) \w+|write (?:two|three|four|five|a few|some|one or two|two or three|\d+) (?:sentences|words|lines|paragraphs) (?:about|on|here)"
    r"|click (?:here )?to edit\b|double[- ]click to edit\b|(?:add|enter|type|put|insert|write) (?:a|an|your|some|the) (?:[\w-]+ ){1,3}?here\b|(?:add|edit) your (?:text|content|own)\b|start writing (?:here|your)\b"
    r"|blindtext\b|texto de (?:relleno|ejemplo|muestra)\b|texte (?:provisoire|de remplissage|factice|d['’]exemple)\b|platzhaltertext\b|beispieltext\b)",
    re.IGNORECASE,
)
_FILLER_SIGNS = re.compile(
    rf"\blorem ipsum\b|\b{_LATIN}(?:[ ,.]+{_LATIN}){{3,}}\b|\breplace (?:it|this)(?: text)? with (?:the|your) \w+|\b{_MASH}(?: (?:{_MASH}|test)){{2,}}|\bx{{3,}}(?:,? x{{2,}}){{3,}}"
    r"|\btexto de relleno\b|\btexte de remplissage\b|\bcontent coming soon\b|\bclick to edit this\b",
    re.IGNORECASE,
)
#: One word over and over.
_REPEATED = re.compile(r"\b([a-z]{4,}+)(?: \1){4}")
#: (kind, forms anywhere, forms where a clause begins, literals of which every hit holds at least one; they spare most texts the expressions).
_MESSAGES = (
    (
        "filler", _FILLER_SIGNS, _FILLER_CLAUSES,
        ("ipsum", "dolor", "amet", "consect", "adipisc", "adipisic", "eiusmod", "incididunt", "aliqua", "aliquip", "veniam", "nostrud", "ullamco", "laboris", "reprehenderit", "voluptate", "cillum", "fugiat", "pariatur", "excepteur",
         "occaecat", "cupidatat", "proident", "deserunt", "mollit", "this is ", "dummy", "placeholder", "filler text", "filler content", "filler copy", "filler paragraph", "sample text", "sample content", "sample paragraph", "sample copy",
         "sample headline", "coming soon", "construction", " here", "replace it", "replace this", "replace me", "write ", "to edit", "edit your", "add your", "start writing", "blindtext", "texto de", "texte ", "platzhalter", "beispieltext",
         "asdf", "sdfg", "dfgh", "ghj", "hjk", "jkl;", "qwer", "rtyu", "tyui", "uiop", "zxcv", "xcvb", "cvbn", "xxx"),
    ),
    (
        "errors", _ERROR_SIGNS, _ERROR_CLAUSES,
        ("not found", "forbidden", "unauthori", "bad request", "timeout", "time-out", "timed out", "too many", "server error", "gateway", "unavailable", "not allowed", "gone", "not be found", "not be l", "not be d", "not be shown", "not be o",
         "not be r", "not be accessed", "not be processed", "not be completed", "’t be ", "'t be ", "failed to", "not exist", "t exist", "longer exist", "n'existe", "n’existe", "not available", "t available", "t accessible", "t working", "not working", "no longer available", "not accessible", "not respond", "t respond", "to respond", "offline", " down", "has removed", "has moved",
         "has deleted", "has expired", "has renamed", "has suspended", "has disabled", "has timed", "been removed", "been moved", "been deleted", "been expired", "been renamed", "been suspended", "been disabled", "been timed",
         "is restricted", "too long to", "maintenance", "out of service", "refused", "was reset", "interrupted", "error", "exception", "traceback", "undefined", "sqlstate", "ora-", "segmentation", "missing", ".java", "denied", "denegado",
         "not have ", "you are not", "sign in ", "log in ", "went wrong", "gone wrong", "are having", "are experiencing", "encountered", "ran into", "unable to", "could not ", "couldn", "can not ", "cannot ", "can't ", "can’t ", "try again",
         "please try", "please check", "checking your", "verify", "captcha", "invalid request", "bandwidth", "closed for", "refus", "interdit", "verweigert", "introuvable", "encontrada", "gefunden", "serverfehler", "interne du", "interno del",
         "geladen", "angezeigt", "erreichbar", "verfügbar", "verfugbar", "disponible", "trouv", "no se ", "inicie", "connectez", "melden sie", "versuchen", "not acceptable", "conflict", "payment required", "not implemented"),
    ),
    ("scripts", _SCRIPT_SIGNS, _SCRIPT_CLAUSES, ("script", "js", "browser", "enable cookies", "turn them on")),
)
KINDS = ("placeholders", "filler", "errors", "scripts")


def _automaton():
    """All literals, each with the places of its kinds in ``_MESSAGES``; one pass over a text finds them."""
    automaton, kinds = ahocorasick.Automaton(), {}
    for i, (*_, literals) in enumerate(_MESSAGES):
        for x in literals:
            kinds.setdefault(x, set()).add(i)
    for x, places in kinds.items():
        automaton.add_word(x, frozenset(places))
    automaton.make_automaton()
    return automaton


_LITERALS = _automaton() if ahocorasick else None


def _possible(low: str) -> set[int]:
    """The places in ``_MESSAGES`` of the kinds of which the text holds a literal."""
    if _LITERALS is None:
        return {i for i, (*_, literals) in enumerate(_MESSAGES) if any(map(low.__contains__, literals))}
    found: set[int] = set()
    for _, places in _LITERALS.iter(low):
        found |= places
        if len(found) == len(_MESSAGES):
            break
    return found


# ------------------------------------------------------------------- discounts

_TOLD = re.compile(
    r"(?:\b(?:such as|for example|e\.g\.|like|called|named|(?:the|a|an|this|that|each) (?:field|variable|token|marker|phrase|term|string|word|message|words|tag|index|column|syntax|literal|placeholder|notice|text|error)"
    r"|(?:asked|told|invited|reminded|instructed|advised|urged)(?: \w+)? to|in braces,?)[ :,]*)$",
    re.IGNORECASE,
)
_AFTER = re.compile(
    r"[\"'”’]?,? (?:columns?|fields?|variables?|tokens?|attribute|placeholders?|syntax|is (?:swapped|replaced|filled|expanded|printed|rendered)|are (?:swapped|replaced|filled|expanded|printed|rendered)|stands? for|means?|refers? to)\b", re.IGNORECASE
)
_BLOCK = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|(?<!<)<(pre|code)(?:\s[^<>]*)?>(?:(?!</?\1\b).)*</\1>|`[^`\n]+`", re.DOTALL | re.IGNORECASE)
_OPEN, _CLOSE = "\"“„«‘'", "\"”“»’'"
_CLAUSE = re.compile(r"[.!?:;,|>)\]…–—]+[\"”’']?\s+|\s[-–—]+\s|[\[(\"“>]|(?<=[\w)] )(?=(?:The|This|That|Your|You|Our|Requested|Sorry|Oops|Unfortunately|We|An?|Access|Page|Please|Kindly|Error|Something|To|For|If|Without|Checking|Content|Dummy|Write|Add|Click|Replace|Die|Der|Das)\b)")
#: Characters before a hit that hold any cue in full.
_CUE = 64


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands right after an opening quotation mark whose closing one follows before the paragraph's end."""
    if start == 0 or text[start - 1] not in _OPEN or (start > 1 and text[start - 2].isalnum()):
        return False
    stop = text.find("\n", end)
    close = [p for p in (text.find(c, end, stop if stop >= 0 else len(text)) for c in _CLOSE) if p >= 0]
    return bool(close)


def _discounted(text: str, start: int, end: int) -> bool:
    """Whether the surroundings of a hit show that the text only writes about such a thing."""
    return bool(_TOLD.search(text, max(0, start - _CUE), start) or _AFTER.match(text, end)) or _quoted(text, start, end)


def _prose(text: str) -> tuple[str, list[int]]:
    """The text on lines of its paragraphs, and where its lines began."""
    parts, starts, at = [], [], 0
    for paragraph in re.split(r"\n[ \t]*\n", text):
        lines = [line for line in (" ".join(x.split()) for x in paragraph.split("\n")) if line]
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        if lines:
            parts.append(" ".join(lines))
    return "\n".join(parts), starts


def _name(m: re.Match) -> str:
    return re.sub(r"\W+", " ", m.group(m.lastgroup)).strip().lower()


def residue_of(text: str | None) -> dict[str, int]:
    """The number of hits of each kind that count; all 0 for null and empty texts."""
    found = dict.fromkeys(KINDS, 0)
    if not text:
        return found
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    explained: set[str] = set()
    lower = text.lower()
    if "`" in text or "~~~" in text or "<pre" in lower or "<code" in lower:
        for block in _BLOCK.finditer(text):
            explained.update(_name(m) for m in PLACEHOLDERS.finditer(" ".join(block.group(0).split())) if _valid(m))
        text = _BLOCK.sub(" ", text)
        lower = text.lower()
    prose, starts = _prose(text)
    if any(x in prose for x in ("{", "@@", "<", "[", "%", "__", "$(")):
        links = "[[" in prose and len(re.findall(r"\[\[[^\[\]]*[ |:][^\[\]]*\]\]", prose)) > 2  # a text of linked pages
        found["placeholders"] = sum(
            _valid(m) and _name(m) not in explained and not (links and m.lastgroup == "wik") and not _discounted(prose, m.start(), m.end()) for m in PLACEHOLDERS.finditer(prose)
        )
    begins: list[int] | None = None
    low = " ".join(lower.split())
    possible = _possible(low)
    for place, (kind, signs, clauses, _) in enumerate(_MESSAGES):
        spans = {m.start(): m.end() for m in _REPEATED.finditer(prose.lower())} if kind == "filler" else {}
        if place not in possible:
            found[kind] = sum(not _discounted(prose, a, b) for a, b in spans.items())
            continue
        if begins is None:
            begins = sorted({*starts, *(m.end() for m in _CLAUSE.finditer(prose))})
            ends = dict(zip(starts, [x - 1 for x in starts[1:]]))  # a message may also end where its line does
        spans |= {m.start(): m.end() for m in signs.finditer(prose)}
        for begin in begins:
            if m := clauses.match(prose, begin) or (begin in ends and clauses.match(prose, begin, ends[begin])):
                spans.setdefault(begin, m.end())
        found[kind] = sum(not _discounted(prose, a, b) for a, b in spans.items())
    return found


def _scan(batches):
    for batch in batches:
        rows = [residue_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int32()) for k in KINDS)], names=["doc_id", *KINDS])


def residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``placeholders``, ``filler``, ``errors``, ``scripts``): hits per document, for every row with a non-null id.

    Null, empty and short texts as such have no hits; whole texts are scanned
    whatever their length; repeated rows are all reported. The scan keeps the
    table's partitioning and shuffles nothing.
    """
    counts = ", ".join(f"{k} int" for k in KINDS)
    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, {counts}").withColumnRenamed("doc_id", doc_id)


_ANY = " + ".join(KINDS) + " > 0"


def residue_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The (``doc_id``) of the documents with residue."""
    return residue(documents, doc_id, text).where(_ANY).select(doc_id)


def without_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without those that hold residue; rows with a null id stay."""
    return documents.join(residue_documents(documents, doc_id, text), doc_id, "left_anti")
