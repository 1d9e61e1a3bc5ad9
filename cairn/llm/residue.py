"""Pages without content of their own: unfilled templates, filler, error pages, notices that scripts are needed.

A text falls into units (sentences, headings, code lines). A unit is frame, content or residue. Pages that have at
most a stray sentence of content are aligned with the other such pages of the corpus: masking what varies gives a
page's template, and the masked places are its slots. A slot that still holds a variable's name, a default or a
blank shows that the template was never filled; a page is also left out if its whole-page template is one that
most of its pages show to be an error page or a notice.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from cairn.llm.anchored import Patterns

#: Sentences of real content that a page of residue may still have.
STRAY = 1

_TAG = re.compile(r"<!--|<(script|style)\b|</?(?:!doctype|html|head|body|div|p|span|title|center|h[1-6r]|hr|br|ul|ol|li|table|thead|tbody|tr|t[dh]|section|article|main|header|footer|nav|a|b|i|em|strong|small|code|pre|noscript|meta|link|img|form|input|button|label)\b[^<>]*>", re.I)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_BANNER = re.compile(r"^={3,} ?\S+ ?={3,}$|^[=\-_*#~+\s]{3,}$")
_LEAD = re.compile(r"^(?:(?:>|//+|/\*+|\*(?= )|#+(?= |$)|--(?= )|;+(?= )|\{#|<!--|[\-*+](?= )|\d+[.)](?= ))\s*)+")
_TRAIL = re.compile(r"\s*(?:\*/|#\}|-->|\|)\s*$")

_VAR = r"[A-Za-z][A-Za-z_]*(?:[ .\-][A-Za-z_]+){0,3}"
#: Slots that were never filled, in the styles of common template languages, and defaults and blanks.
SLOT = re.compile(
    rf"\{{\{{-?\s*{_VAR}\s*-?\}}\}}|\{{%-?\s*(?!(?:end)?(?:if|for|set|block|raw|macro|filter|call|with)\b|else|elif|include|extends|import|from){_VAR}\s*-?%\}}|<%=?\s*{_VAR}\s*%>|\$\{{{_VAR}\}}|\$\[{_VAR}\]|#\{{{_VAR}\}}|@@{_VAR}@@|%%{_VAR}%%|%[A-Za-z][A-Za-z_]+%"
    rf"|<<\s*{_VAR}\s*>>|\[\[\s*{_VAR}\s*\]\]|\b__[A-Za-z][A-Za-z_]*?__(?!\w)|\[(?:insert|enter|your|add|fill|put)\b[^\]\n]{{0,40}}\]|<(?:insert|enter|your|add|fill)\b[^>\n]{{0,40}}>|<!--\s*(?:write|insert|add|enter|fill|put|describe|todo)\b[^>]{{0,60}}-->"
    rf"|\((?:fill in|insert|enter|add|your)\b[^)\n]{{0,40}}\)|\bTODO\({_VAR}\)|\bYYYY-MM-DD\b|\bDD[./]MM[./]YYYY\b|\bMM/DD/YYYY\b|_{{5,}}|\bX{{4,}}\b|\btb[da]\b(?!\.\w)|<[A-Z][A-Z_]+(?: [A-Z_]+){{0,3}}>|\[(?:name|title|author|owner|year|version|date|license|contact|description|usage|team|email|company|project|ticket|repo)[a-z_ ]*\]"
    rf"|(?<![\w$#{{%]|\")\{{{_VAR}\}}(?!\"|\}})|_[A-Z][^_\n]{{3,60}} here\._"
    # What is to be filled in, in brackets: alone, in several words, or at the end of a phrase.
    r"|^\[[^\W\d][^\[\]\n|=]{2,60}\]$|(?-i:\[[A-ZÄÖÜ][a-zäöüß]+(?: [A-Za-zäöüß]+){1,5}\](?![(\[:]))|(?-i:\[[A-ZÄÖÜ][A-ZÄÖÜ ]{3,30}\](?![(\[:\w ]))|(?-i:\[[A-ZÄÖÜ][a-zäöüß]{2,30}\](?=[,.!?]?$))|^(?:\[ \] )?TODO\.?$"
    # Names of what is to be filled in, in capitals, in the midst of a sentence.
    r"|(?-i:(?<![\w.\-$(])(?<![A-Z] )(?:FIRST ?|LAST ?|FULL ?|YOUR ?)?(?:NAME|COMPANY|PRODUCT|CUSTOMER|RECIPIENT|SENDER|ADDRESS|CITY|COUNTRY|AMOUNT|ORGANI[SZ]ATION|DEPARTMENT|POSITION)(?=[,.!?]?$|[,;!?] ))",
    re.I,
)
_SLOT_STRICT = re.compile(r"[A-Z]{4,}|^_|tb[da]$", re.I)

# Words of filler text.
_LATIN = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui "
    "officia deserunt mollit anim id est laborum aeque amnis arcus caldera cursus ferrum flamma fragor gelidus gravis littera moritas nectare novem orbita pontem portus quendam silva sonat tarda tellus umbra "
    "velum ventis vulpes vestibulum mauris praesent nullam vivamus pellentesque curabitur phasellus donec aenean integer nunc maecenas suspendisse".split()
)
_ORDINARY = set("the a an of to and is are was for with that this it on as by from be or not der die das und ist nicht ein eine mit le la les des et est un une pour que el los las y una por para o os as um uma com não il di che per и в не на с".split())

_FILLER = re.compile(
    r"(?i)\b(?:placeholder|dummy|filler|sample|example) (?:paragraph|text|content|copy|heading|title|caption)\b|\bblindtext\b|\bplatzhaltertext\b|\btexto? (?:de relleno|provis[oó]rio|fictício)|\btexte? (?:de remplissage|fictif|factice|provisoire|bidon)|\btesto (?:segnaposto|di prova|fittizio)|\bздесь (?:будет|должен быть) (?:ваш )?текст|\bтекст[- ]заглушка|\bрыба[- ]текст|ダミーテキスト"
    r"|\b(?:here could be|your) (?:text|content|copy)\b(?: (?:goes )?here)?|\b(?:text|content) (?:goes|comes) here\b|\bhier k[öo]nnte (?:ihr|dein) text\b|\breplace this (?:text|paragraph|section)\b|\bcoming soon\b$|\bunder construction\b|\badd a short (?:introduction|description|summary) here\b"
    r"|^describe (?:your|the) (?:changes?|issues?|problems?|bugs?)\b.{0,40}$|^_?(?:explain|describe|list|summari[sz]e|add|write) (?:the|your|a|any)\b.{3,60}\bhere\b\.?_?$|^inputs: \.\.\.|^outputs: \.\.\.|^known limits: \.\.\."
)
_BLANK = re.compile(r"^[\w ]{2,30}:\s*(?:\.\.\.|…|-{1,3}|\?+|n/a)$")
_STUB = re.compile(r"(?i)^(?:[\s,;|/]*\b(?:(?:caption|section|card|page|main|sub)[ -]?(?:text|title|heading)|(?:heading|title|headline|subheading|subtitle|paragraph|body text|lorem|label|link|image|item|button)(?: (?:\d+|one|two|three|four|label|text|caption))?|\w+ label|button \w+|text|content|test|blah|asdf|qwerty|foo(?: bar)?(?: baz)?|xxx+|item (?:\d+|one|two|three))\b)+[.,;]?$")

_SCRIPT = r"(?:java ?script|js|ecmascript|scripts?(?:ing)?|active content|client-side rendering|dynamic content)"
_NOTICE = re.compile(
    rf"(?i)\b(?:enable|activate|turn(?:ing)? on|switch on|allow|permit|need|needs|require[sd]?|without|unblock)\b[^.!?\n]{{0,60}}\b{_SCRIPT}\b"
    rf"|\b{_SCRIPT}\b[^.!?\n]{{0,60}}\b(?:enabled?|required?|needed|necessary|disabled|blocked|blocking|allowed|not available|unavailable|turned (?:on|off)|switched (?:on|off)|supported)\b|\bblocks? scripts?\b|\bscript blocking\b"
    r"|\b(?:aktivieren|aktiviere|benötigt|erfordert|einschalten)\b[^.!?\n]{0,40}\bjava ?script\b|\bjava ?script\b[^.!?\n]{0,60}\b(?:aktivieren|aktiviert|benötigt|erforderlich|einschalten|deaktiviert)\b"
    r"|\b(?:activez|activer|nécessite|habilite|habilitar|active|activar|activa|requiere|ative|ativar|requer|attivare|attiva|abilita|abilitare|richiede|zet|schakel|vereist|włącz|slå på)\b[^.!?\n]{0,40}\bjava ?script\b|\bjava ?script\b[^.!?\n]{0,40}\b(?:requis|désactivé|desactivado|desativado|necesario|necessário|disabilitato|richiesto)\b"
    r"|(?:включите|включить|разрешите|требуется|необходим\w*)[^.!?\n]{0,40}java ?script|java ?script[^.!?\n]{0,40}(?:отключ|выключ|включите|не поддерж)|java ?script を有効|请启用 ?java ?script|java ?scriptを有効"
)
_NOTICE_TAIL = re.compile(r"(?i)^(?:enable it in (?:the|your) settings|turn it on and reload|switch to a supported browser|it seems to be disabled|if nothing happens|please reload|reload the page|loading)\b")

_ERROR = re.compile(
    r"(?i)\b(?:page|file|link|resource|document|site|url|object|entry|item|article|content|\w+) (?:was |could )?not (?:be )?(?:found|loaded|available)\b|\bnot found\b|\b(?:bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|forbidden|unauthorized|bad request|request time-?out|payload too large|method not allowed)\b|\b[45]\d\d (?:gone|error|not found)\b|\berror [45]\d\d\b|\bhttp/\d(?:\.\d)? [45]\d\d\b"
    r"|\baccess(?: to this \w+)?(?: is| was|)? ?denied\b|\b(?:access|permission) (?:denied|required)\b|\byou (?:are not allowed|do not have (?:permission|access)|don't have (?:permission|access))\b|\byour (?:address|ip)\b.{0,20}\b(?:was|has been|is) (?:blocked|banned)\b|\bblocked by the firewall\b"
    r"|\b(?:session|login|link) (?:has )?(?:expired|timed out)\b|\b(?:please )?(?:log|sign) in (?:again )?to (?:view|see|continue|access)\b|\bis private\b.{0,5}$|\bask its owner for access\b|\brequest (?:limit|rate)\b|\brate limit(?:ed)?\b|\breached the (?:request|rate|download) limit\b"
    r"|\b(?:scheduled|planned|undergoing) maintenance\b|\bdown for (?:scheduled )?maintenance\b|\bwe'll be (?:right )?back\b|\bbe right back\b|\btemporarily (?:unavailable|down|offline|not available)\b|\bis (?:currently )?(?:unavailable|offline)\b|\bout of service\b"
    r"|\btook too long to respond\b|\bcan'?t be reached\b|\bhaving trouble (?:finding|loading|connecting|reaching)\b|\b(?:can'?t|cannot|could not|couldn't) connect to (?:the|this|that) (?:server|site|host|page)\b|^(?:http )?(?:40[013458]|410|429|50[0234])\s+[-–—:|]\s|\bERR_[A-Z_]{4,}\b|\bDNS_PROBE\w*|\bconnection (?:refused|reset|timed out|failure)\b|\bupstream connect error\b|\bdisconnect before headers\b|\berror establishing a database connection\b|\bdatabase error\b"
    r"|\bchecking your (?:connection|browser)\b|\bverify (?:that )?you are (?:a )?human\b|\breview the security of your connection\b|\bcaptcha\b|\bunusual traffic\b"
    r"|\b(?:something|that) (?:went wrong|broke)\b|\b(?:enable|allow|accept|activate|turn on|switch on) (?:\w+ ){0,2}cookies\b|\bcookies (?:are|must be|seem to be) (?:\w+ )?(?:disabled|blocked|required|enabled|turned off)\b|\b(?:oops|whoops|hmm|uh-oh|sorry|ouch|yikes|uh oh|oh no|bummer|argh|dang)\b[!,. ]|\b(?:is )?(?:not|no longer) in use\b|\bif (?:it|this) keeps happening\b|\bquota (?:used up|exceeded)\b|\bnothing (?:lives |is )?(?:to see )?here\b|\bwe (?:can't|cannot|couldn't) find (?:that|the|this)\b|\bwe lost that\b|\bleads nowhere\b|\bhas (?:been )?(?:moved|removed|deleted)\b|\bmay have been (?:moved|renamed|deleted|removed)\b|\bno longer (?:exists|available)\b"
    r"|\bapplication error\b|\b(?:client|server)-side exception\b|\bunhandled exception\b|\btraceback \(most recent call last\)|\bfatal: unable to\b|\bunable to (?:read|load|connect|fetch)\b|\brepository unavailable\b|\bfetch failed\b|\bbody omitted\b|\bthe remote answered\b|\bno such (?:blob|key|object|bucket|file)\b|\bobject is archived\b|<code>accessdenied"
    r"|\bseite (?:nicht|konnte nicht)\b|\bnicht gefunden\b|\bzugriff verweigert\b|\bkeine berechtigung\b|\bnicht erreichbar\b|\bexistiert nicht\b|\bwartungsarbeiten\b|\bfehler [45]?\d\d\b|\bsitzung (?:ist )?abgelaufen\b"
    r"|\berreur [45]?\d\d\b|\bintrouvable\b|\baccès (?:refusé|interdit)\b|\bindisponible\b|\bréessayer plus tard\b|\bpágina no (?:encontrada|existe|disponible)\b|\bya no está disponible\b|\bacceso denegado\b|\berror del servidor\b|\bpágina não (?:encontrada|existe)\b|\bacesso negado\b|\bindisponível\b|\bpagina non trovata\b|\baccesso negato\b|\bnon (?:è )?(?:più )?disponibile\b|\bniet gevonden\b|\btoegang geweigerd\b"
    r"|ошибка \d*|не найдена?|недоступн|доступ запрещ|страница (?:не|удал)|ページが見つかりません|アクセスが拒否|エラー|找不到|无法访问|拒绝访问"
)
_ERROR_TAIL = re.compile(
    r"(?i)^(?:try again(?: later)?\b.{0,60}|please try again.{0,40}|try:?|checking the (?:connection|proxy|firewall).{0,20}|(?:reference|ray|incident|request|trace|vorgang|code|detail|host|status|content-length|x-[\w\-]+|ref|id)\b[ :=#\"].{0,80}|go back\b.{0,60}|(?:report|tell|contact)\b.{0,60}|(?:thank you|thanks) for your patience\.?|zurück zur? .{0,30}|vuelva .{0,30}|merci de .{0,40}|wait \d+ \w+.{0,60}|if you think this is a mistake.{0,60}|sign in to see more\.?|file \"[^\"]+\", line \d+.{0,60}|return \w+\(.{0,60}\)|\w+(?:error|missing|exception)\b.{0,80}|the page \S+ could not.{0,80}|reset reason.{0,60}|\S+ said \d+.{0,40}|[\w.\-]+\.(?:test|example|invalid|com|org|net)\b.{0,90})$"
)
#: How an error as data begins.
_BODY = re.compile(r'(?i)(?:\{\s*"?(?:message|error|detail|status|code|title)"?\s*[:=]|\{\s*"(?:timestamp|path|request_?id|trace_?id|type|instance|success|ok)"\s*:|<\?xml[^<>]*>\s*<error>|error:?\s*\{|http/\d(?:\.\d)? [45]\d\d\b)')
_PAIR = re.compile(r"""["']?([A-Za-z_][\w\-]*)["']?\s*[:=]\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s,;{}\[\]"']+)""", re.S)
_HEADER_LINE = re.compile(r"[A-Za-z][\w\-]*: ?.*")
#: An error as data, somewhere in a page: where it begins, and the status it must have.
_INNER_BODY = re.compile(r'(?i)"?error"?\s*:?\s*\{|\{\s*"?(?:message|error|title|detail)"?\s*[=:]')
_STATUS = re.compile(r'(?i)\b(?:code|status)"?\s*[=:]\s*"?[45]\d\d\b')
# What errors as data consist of besides; what else they hold is content if it reads so.
_ERROR_KEYS = set("message error errors detail details status code title reason description type name statuscode status_code errorcode error_code error_description trace stack stacktrace stack_trace traceback exception cause request_id requestid trace_id timestamp path instance resource".split())
_SIGN_KEYS = set("message error errors detail details title reason description type name code status statuscode status_code errorcode error_code error_description exception".split())
_BODY_SIGN = re.compile(r"(?i)[45]\d\d|denied|forbidden|not found|error|unavailable|timeout|archived|no such")
_MENU = re.compile(r"(?i)^(?:skip to (?:main )?content|menu|search|home|docs|sign (?:in|up|out)|log ?(?:in|out)|overview|pricing|files|history|start|help|status|contact|privacy|terms|cookies|imprint|feedback|about|next|previous|back|[|·•\-–/\s,])+$")
_CODE = re.compile(r"[;{}]\s*$|^\s*[\w.\[\]\"'\-]+\s*(?:=|:=|\+=)\s*\S|^\s*(?:def|class|import|from|package|func|fn|pub|const|let|var|if|for|while|return|match|SELECT|UPDATE|INSERT|FROM|COPY|RUN|ENV|EXPOSE|export|public|private|static|@\w+)\b.*[({:;=]|\w\(.*\)\s*[;{:]?$|^\s*[\"']?[\w.\-]+[\"']?\s*:\s*(?:[\"'\[{\d]|\S+$)|^\s*\[[\w.\-]+\]$|\{%-?\s*(?:if|for|set|block|end)|\|\s*default\(|^\s*-\s+\w+:|^\s*sed\b|^#!")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'(_*`\[<{$#%@A-ZА-ЯÄÖÜÁÉÍÓÚÇ\d])|\s{2,}|\n+")
#: What stands in quotes; an apostrophe inside of a word is none.
_QUOTED = re.compile(r"(?:[\"`“„«]|(?<!\w)')(?:[^\"`“„«»”\n]{6,}?)(?:[\"`”“»]|'(?!\w))")
#: What tells of an error instead of being one.
_NARRATED = re.compile(r"(?i)\bbecause (?:the|it|its|a|an)\b|\bthe (?:client|caller|handler|exporter|parser|fix|test|tests|router|commit|patch)\b|\b(?:answers|answered|responds|responded) with\b")
_LABELLED, _SHOWN_ERROR = re.compile(r"^[A-Za-z]+: "), re.compile(r"(?i)traceback|http/")
_TITLE_WORDS = 7
_CONTROL = re.compile(r"\{%-?\s*(?:if|for|set|block|macro|end\w+)\b|\{\{[#/]\w+|<%\s*(?:if|for|end)\b|\|\s*default\(")
_SOURCE_LANG = {"jinja", "jinja2", "j2", "handlebars", "hbs", "erb", "mustache", "liquid", "twig", "ejs", "pug", "velocity", "smarty", "tmpl", "tpl", "gotmpl", "cookiecutter"}
_SOURCE_PATH = re.compile(r"(?i)\.(?:j2|jinja2?|hbs|erb|mustache|liquid|twig|ejs|pug|vm|tpl|tmpl|gotmpl|in)$|(?:^|[\\/])(?:templates?|cookiecutter[\w\-]*|scaffold(?:ing)?|skeletons?)[\\/]")


# Status codes of errors, as titles begin or end with them.
_STATUS_CODES = {"400", "401", "403", "404", "405", "408", "410", "418", "429", "500", "502", "503", "504"}
#: A page whose signs are those of no language has at most so many words.
HINT_WORDS = 60
_SCRIPTS = re.compile(r"(?i)(?<![\w.])(?:java[ \-]?script|js)(?![\w.])")
_TITLE = re.compile(r"(?i)<(?:title|h1|noscript)\b")


def _hint(kept: list[str], words: int) -> str:
    """error or script if signs that need no language say so: a status code as a title, or scripts named in prose."""
    if words > HINT_WORDS or any(_CODE.search(unit) for unit in kept):
        return ""
    if any(_SCRIPTS.search(unit) for unit in kept):
        return "script"
    return "error" if any(_status_title(unit) for unit in kept) else ""


def _status_title(unit: str) -> bool:
    """Whether a short line begins or ends with the status code of an error."""
    plain = re.findall(r"\w+", unit)
    return 1 <= len(plain) <= 8 and (plain[0] in _STATUS_CODES or plain[-1] in _STATUS_CODES)


@dataclass
class Page:
    """A text with at most a stray sentence of content."""

    kind: str  # template, filler, error, script, or '' for none
    slots: int  # slots that were never filled
    units: int
    template: str  # digest of the page with all that varies masked
    words: int
    hint: str = ""  # the kind that signs without words of any language speak for, which counts if the template is repeated


def _latin(words: list[str]) -> bool:
    low = [w.strip(".,;:!?()").lower() for w in words]
    known = sum(w in _LATIN for w in low)
    return len(low) >= 4 and known >= 0.7 * len(low)


class _Drawn:
    """Words in the way of filler: long enough, plain letters, no ordinary small word, few words again and again."""

    def __init__(self) -> None:
        self.words, self.distinct, self.possible = 0, set(), True

    def add(self, unit: str) -> None:
        low = [w.strip(".,;:!?").lower() for w in unit.split()]
        self.words += len(low)
        self.distinct.update(low)
        # Only these two can't be made good by what follows; the share of distinct words can.
        self.possible = self.possible and all(w.isalpha() and w not in _ORDINARY for w in low)

    def holds(self) -> bool:
        return self.possible and self.words >= 40 and len(self.distinct) <= 0.5 * self.words


def _blocks(text: str, size: int = 2048) -> Iterator[str]:
    """text in pieces that end with a line."""
    at = 0
    while at < len(text):
        end = text.find("\n", min(len(text), at + size))
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def _untagged(text: str) -> Iterator[str]:
    """text between its tags, and its comments; scripts and styles are left out with all they hold, however long.

    What is opened and never closed isn't an element; a close that isn't there is looked for once.
    """
    at = pos = 0
    missing: set[str] = set()
    while m := _TAG.search(text, pos):
        end, comment = m.end(), ""
        name = "!--" if m[0] == "<!--" else (m[1] or "").lower()
        if name and name in missing:
            pos = end
            continue
        if name == "!--":
            close = text.find("-->", end)
            stop = close + 3 if close >= 0 else -1
            if close >= 0:
                comment = text[m.start() : stop] if SLOT.fullmatch(text, m.start(), stop) else text[end:close]
        elif name:
            opened = text.find(">", end)
            closed = _CLOSE[name].search(text, opened + 1) if opened >= 0 else None
            stop = closed.end() if closed else -1
        else:
            stop = end
        if stop < 0:
            missing.add(name)
            pos = end
            continue
        yield text[at : m.start()]
        yield comment
        at = pos = stop
    yield text[at:]


def _slot(line: str) -> bool:
    return _SIGNS.search("slot", line, _SIGNS.hits(line.lower())) is not None


def units(text: str) -> Iterator[str]:
    """The units of text, one after the other; lines are cut into sentences unless they are code."""
    for block in (b for piece in (_untagged(text) if "<" in text else (text,)) for b in _blocks(piece)):
        for line in block.split("\n"):
            bare = _TRAIL.sub("", _LEAD.sub("", line.strip().lstrip("\ufeff"))).strip()
            if not bare or _BANNER.match(bare):
                continue
            if _CODE.search(bare) and not _slot(bare):
                yield line.strip()
            else:
                yield from (s.strip() for s in _SENTENCE.split(bare) if s.strip())


#: All that names a kind of residue, behind one automaton of the literals that its patterns can't do without.
_SIGNS = Patterns({"slot": SLOT.pattern, "script": _NOTICE.pattern, "error": _ERROR.pattern, "filler": _FILLER.pattern}, re.I)


@lru_cache(maxsize=1 << 16)
def _kind(unit: str) -> str:
    """frame, content, tail (what only follows a notice or an error), or the kind of residue."""
    bare = _TRAIL.sub("", _LEAD.sub("", unit)).strip()
    words = bare.split()
    if not words or _MENU.match(bare) or _BANNER.match(bare):
        return "frame"
    if _BLANK.match(bare):
        return "template"
    hits = _SIGNS.hits(bare.lower())
    groups = {name for name, _ in hits}
    code = bool(_CODE.search(bare))
    told = False
    if "script" in groups or "error" in groups:
        quoted = _QUOTED.search(bare)
        told = quoted is not None and bool(_ERROR.search(quoted[0]) or _NOTICE.search(quoted[0]))
    if not told and ("script" in groups and len(words) <= 25 and not code and _SIGNS.search("script", bare, hits) or _NOTICE_TAIL.match(bare)):
        return "script"
    if len(words) >= 6 and len({w.strip(".,;").lower() for w in words}) <= 2:
        return "filler"
    if "filler" in groups and len(words) <= 16 and not code and _SIGNS.search("filler", bare, hits) or _STUB.match(bare):
        return "filler"
    if len(words) <= 24 and "slot" in groups and _SIGNS.search("slot", bare, hits) and not (_CODE.search(SLOT.sub("S", bare)) and not _LABELLED.match(bare)):
        return "template"
    if "error" in groups and not told and not _NARRATED.search(bare) and len(words) <= 26 and not (code and not _SHOWN_ERROR.match(bare)) and _SIGNS.search("error", bare, hits):
        return "error"
    if _latin(words):
        return "filler"
    if _ERROR_TAIL.match(bare):
        return "tail"
    if code or _CODE.search(unit):
        return "content"
    if len(words) <= 3 or len(words) <= _TITLE_WORDS and bare[-1] not in ".!?":
        return "frame"
    return "content"


def _skeleton(unit: str) -> str:
    masked = SLOT.sub("{}", unit)
    masked = re.sub(r"https?://\S+|\b[\w\-]+(?:\.[\w\-]+)+\b|\b[0-9a-f]{8,}\b|\d+", "#", masked.lower())
    return re.sub(r"\s+", " ", masked)


def _pairs(data: object, key: str = "") -> Iterator[tuple[str, str]]:
    """Key and value of all that data, read from JSON, holds at any depth; items of lists have the list's key."""
    todo = [(key, data)]
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += [(str(k), v) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(key, v) for v in value]
        elif value not in (None, "", False):
            yield key, str(value)


def _read(body: str) -> list[tuple[str, str]]:
    """The pairs of a body in braces, as JSON or else as names with values."""
    try:
        return list(_pairs(json.loads(body)))
    except (ValueError, RecursionError):
        return [(m[1], m[2].strip("\"'")) for m in _PAIR.finditer(body)]


def _content_units(text: str) -> int:
    """Sentences of content in text, counted no further than needed."""
    n = 0
    for unit in units(text):
        n += _kind(unit) == "content"
        if n > STRAY:
            break
    return n


def _error_body(text: str) -> bool:
    """Whether text, which begins as an error as data does, is one as a whole and holds nothing else, whatever its length."""
    low = text[:5].lower()
    if low == "http/":
        head, _, body = re.sub(r"\r\n?", "\n", text).partition("\n\n")
        status, *headers = head.split("\n")
        body = body.strip()
        if headers and all(_HEADER_LINE.fullmatch(h) for h in headers):
            return True  # a response with its headers: all that follows is what it answers
        rest = "\n".join([*headers, body])
        return len(status.split()) <= _TITLE_WORDS and (bool(_BODY.match(body) and _error_body(body)) or _content_units(rest) <= STRAY)
    if low.startswith("<?xml"):
        return text.lower().endswith("</error>") and bool(_BODY_SIGN.search(text))
    if not text.endswith("}"):
        return False
    pairs = _read(text[text.index("{") :])
    sign = low.startswith("error") or any(k.lower() in ("error", "errors") or k.lower() in _SIGN_KEYS and _BODY_SIGN.search(v) for k, v in pairs)
    return sign and _content_units("\n".join(v for k, v in pairs if k.lower() not in _ERROR_KEYS and " " in v)) <= STRAY


def _without_inner_bodies(text: str) -> str:
    """text with a notice in place of each error as data that has an error's status; '' if there is none."""
    parts, at = [], 0
    pos, decoder = 0, json.JSONDecoder()
    while m := _INNER_BODY.search(text, pos):
        brace = text.index("{", m.start())
        try:
            _, stop = decoder.raw_decode(text, brace)
        except (ValueError, RecursionError):
            close, opened = text.find("}", brace), text.find("{", brace + 1)
            stop = close + 1 if close >= 0 and not 0 <= opened < close else -1
        pos = brace + 1
        if stop < 0 or not _STATUS.search(text, brace, stop):
            continue
        if _content_units("\n".join(v for k, v in _read(text[brace:stop]) if k.lower() not in _ERROR_KEYS and " " in v)) > STRAY:
            continue
        parts += [text[at : m.start()], "\nPage not found\n"]
        at = pos = stop
    return "".join([*parts, text[at:]]) if parts else ""


def is_source(text: str, lang: str | None, path: str | None) -> bool:
    """Whether text is the source of a template, by language, path or control structures."""
    return (lang or "").strip().lower() in _SOURCE_LANG or bool(path and _SOURCE_PATH.search(path)) or bool(_CONTROL.search(text))


def page(text: str | None, lang: str | None = None, path: str | None = None) -> Page | None:
    """What text is as a page, or None if it has content of its own, or is empty or very short.

    Template sources (by language, path, or control structures) aren't unfilled templates. Nulls and texts of under
    three words give None, unless they are an error. The scan ends with the first sentence of content
    too many, unless all content so far may still be drawn filler.
    """
    if text is None:
        return None
    stripped = text.strip().lstrip("﻿").strip()
    if len(stripped) < 12:
        return None
    if _BODY.match(stripped) and _error_body(stripped):
        return Page("error", 0, 1, _digest([_skeleton(stripped)]), len(stripped.split()))
    if "{" in stripped and _STATUS.search(stripped):
        plain = re.sub(r"</?(?:p|div|pre|code|span)\b[^<>]*>|^[ \t]*>[ \t]?", "", stripped, flags=re.M)
        text = _without_inner_bodies(plain) or text
    counts: dict[str, int] = {}
    told: dict[str, int] = {}
    content, slots, total, kept, signs, drawn = 0, 0, 0, [], [], _Drawn()
    trace = False
    for unit in units(text):
        kind = _kind(unit)
        if trace and kind == "content" and _ERROR_TAIL.match(unit):
            kind = "tail"
        trace = trace or unit.lower().startswith("traceback (")
        total += 1
        if kind == "content":
            if unit in told:
                told[unit] += 1
                continue
            told[unit] = 1
            content += 1
            drawn.add(unit)
            if content > STRAY and not drawn.possible:
                return None
        else:
            counts[kind] = counts.get(kind, 0) + 1
            if kind == "frame" and not _MENU.match(unit):
                told[unit] = told.get(unit, 0) + 1
        slots += max(1, len(SLOT.findall(unit))) if kind == "template" else 0
        kept.append(unit)
        if kind not in ("frame", "content", "tail"):
            signs.append(unit)
    # Titles, menus and a stray sentence differ between pages of one template; what shows its kind doesn't.
    skeleton = sorted({_skeleton(unit) for unit in signs}) or [_skeleton(unit) for unit in kept]
    source = is_source(stripped, lang, path)
    if content > STRAY:
        if not drawn.holds():
            return None
        return Page("filler", 0, total, _digest(skeleton), len(stripped.split()))
    kind = ""
    if counts.get("error"):
        kind = "error"
    if counts.get("script"):
        kind = "script"
    if counts.get("filler", 0) >= 1 and not kind:
        kind = "filler"
    if slots >= 2 and not source:
        kind = "template"
    if kind == "template" and source:
        kind = ""
    # The same sentence again and again says nothing.
    if not kind and (_repeated(stripped) or any(n >= 3 and len(u.split()) >= 3 and not _CODE.search(u) for u, n in told.items())):
        kind = "filler"
    words = len(stripped.split())
    hint = "" if kind else _hint(kept, words)
    # A title in markup, or a status code as the first line of several, needs no other page beside it.
    if hint and (_TITLE.search(stripped) or hint == "error" and len(kept) > 1 and _status_title(kept[0])):
        kind = hint
    return Page(kind, slots, total, _digest(skeleton), words, hint)


def _repeated(text: str) -> bool:
    """One or two words or lines, again and again."""
    words = [w for w in re.split(r"[\s,;.|/<>]+", text.lower()) if w and w not in ("div", "p", "class=\"page\"", "br")]
    return len(words) >= 8 and len(set(words)) <= 3


def _digest(parts: list[str]) -> str:
    return hashlib.md5("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
