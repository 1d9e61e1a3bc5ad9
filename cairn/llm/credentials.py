"""Literal credentials in text: where they are, and the text without them.

One deterministic automaton holds token formats, key armor, connection strings, headers, the names that credentials
are assigned to, and values that stand alone. It goes over overlapping chunks of all texts of a batch once (see dfa).
The lines on which it may have matched go to the exact grammars of what was hit; their spans are absolute and
deduplicated, and each is replaced on its own.
"""

from __future__ import annotations

import base64
import binascii
import re
from functools import lru_cache

from cairn.llm.anchored import Patterns
from cairn.llm.dfa import Automaton

# What literal credentials look like that can be known by their form alone.
TOKEN_FORMS = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[opsur]_[0-9A-Za-z]{36,}",
    r"github_pat_[0-9A-Za-z_]{50,}",
    r"glpat-[0-9A-Za-z_\-]{20,}",
    r"AIza[0-9A-Za-z_\-]{35}(?![0-9A-Za-z])",
    r"ya29\.[0-9A-Za-z_\-]{20,}",
    r"xox[abeoprs]-[0-9A-Za-z\-]{16,}",
    r"xapp-[0-9A-Za-z\-]{20,}",
    r"[srp]k_(?:live|test)_[0-9A-Za-z]{16,}",
    r"whsec_[0-9A-Za-z+/=]{20,}",
    r"sk-(?:ant|proj|or|svcacct)-[0-9A-Za-z_\-]{20,}",
    r"sk-[0-9A-Za-z]{20,}",
    r"eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{16,}",
    r"SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}",
    r"npm_[0-9A-Za-z]{36}",
    r"pypi-[0-9A-Za-z_\-]{32,}",
    r"hf_[0-9A-Za-z]{30,}",
    r"dop_v1_[0-9a-f]{64}",
    r"shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}",
    r"AGE-SECRET-KEY-1[0-9A-Z]{50,}",
    r"sq0(?:csp|atp)-[0-9A-Za-z_\-]{22,}",
    r"key-[0-9a-f]{32}(?![0-9A-Za-z])",
    r"https://hooks\.[0-9a-z.\-]+/services/T[0-9A-Z]{6,}/B[0-9A-Z]{6,}/[0-9A-Za-z]{16,}",
    r"\d{8,10}:[0-9A-Za-z_\-]{35}(?![0-9A-Za-z_\-])",
]
_TOKEN = re.compile(r"(?<![0-9A-Za-z_\-/+])(?:" + "|".join(TOKEN_FORMS) + ")(?!\\*)")
# The first characters of such tokens, enough to know a value that is continued in another piece.
TOKEN_STARTS = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- AIza xoxa- xoxb- xoxe- xoxo- xoxp- xoxr- xoxs- xapp- sk_live_ rk_live_ sk_test_ sk- eyJ SG. npm_ pypi- hf_ whsec_".split()

# Words that a name of a credential ends with, in several languages.
SECRET_WORDS = set(
    "password passwd passwort passphrase passcode pass pwd pw secret secrets token tokens credential credentials cred creds apikey authtoken "
    "accesstoken authkey kennwort kennung motdepasse clave contraseña contrasena senha palavrapasse пароль hmac jwt cookie sessionid sid psk wachtwoord hasło heslo lösenord salasana".split()
)
# Words before "key" that make it one that lets in or signs.
KEY_WORDS = set("api access auth private signing sign master encryption storage license account shared secret service client app admin deploy ssh tls host hmac webhook session root bot registry server fernet cipher aes jwt cookie vault".split())
# Last words that make a name tell of a credential instead of holding it.
_HARMLESS = set(
    "path file filename dir name names id ids hash hashes digest pub public field fields length len count counts budget limit limits max min days ttl hours seconds "
    "timeout expiry expires type kind url uri policy hint label prompt ref refs env var store manager provider scope family size status usage rotation helper prefix suffix pattern regex format version".split()
)

_NAME = r"[^\W\d](?:[\w\-.]|(?<=\w) ?\[['\"](?=\w))*"
_PLACE = re.compile(
    r"""(?ix) ^\W*$ | ^<.*>$ | ^\[.*\]$ | ^\{.*\}$ | ^%.*%$ | ^__\w+__$ | \$\{ | \$\( | \{\{ | %\(\w+\) | <[a-z_\- ]+> | ^\$\w+ | ^%\w+%?$ | \*{3} | ••• | ^x{4,}$ | x{6} | ^\.+$ | \.\.\.$ | …
    | redacted | masked | removed | placeholder | replace | change[_\-. ]?(?:me|it|this) | your[_\-. ]|^your | insert | todo | fixme | dummy | sample[_\-]?(?:key|token|secret) | example[_\-.]?(?:key|token|secret|pass|value)|example$ | ^ex[ae]mple
    | ^(?:vault|env|ssm|secretsmanager|arn|kms|file|ref|op|keyring|keychain|sops|doppler|gcp|aws|azure|akv|config|secret|secrets)[:/] | ^(?:aws:)?arn:
    | ^(?:none|null|nil|true|false|yes|no|undefined|void|empty|unset|default|string|str|text|int|integer|number|bool|boolean|object|any|bytes|required|optional|hidden|secret|password|token|test|foo|bar|n/a|tbd|process|prompt|ask|set|get|see)$
    | (?-i:^(?:/|\./|~/|[A-Za-z]:\\)[a-z0-9_.\-]*(?:[/\\][a-z0-9_.\-]+)*[/\\]?$) | \.(?:key|pem|age|crt|json|ya?ml|txt|env|gpg|asc|p12|pfx|jks)$ | ^[\w./\-]+/[\w.\-]+\.\w{2,4}$ | ^(?:os|process|sys|env|config|settings|self|this|cfg|vault|secrets)\. | ^!\w+ | ^@\w+ | ^&\w+$
    | ^0+$ | ^1234 | ^(?:abc|qwe)\w{0,4}$ | ^(.)\1{5,}$ | ^\d{1,7}$ | ^\d+(?:\.\d+)?(?:ms|s|m|h|d|kb|mb|gb)?$ | -credentials?$ | ^input\[ | ^ssh-(?:ed25519|rsa)\b | ^ecdsa-
    | ^\$2[abxy]\$ | ^\$(?:argon2|5|6|1)\b | ^sha\d+[-:] | ^md5[-:] | ^data: | -----BEGIN\ (?:[A-Z]+\ )*(?:PUBLIC|CERT) """
)


def _words(name: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-zа-я0-9])(?=[A-ZА-Я])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    return [w for w in re.split(r"[^\w]+|_+", spaced.lower()) if w]


_JOINED = re.compile(
    r"(?:password|passwd|passwort|passphrase|motdepasse|kennwort|secret|token|credentials?|creds|pwd|(?<=[a-z]{4})pw|(?:store|key|bind|smtp|db|user|root|admin|ssh|ftp|mail|ldap|proxy|bot|git)pass|bindpw|(?:"
    + "|".join(sorted(KEY_WORDS))
    + r")key|smtppass|dbpass|пароль|pincode)$"
)


@lru_cache(maxsize=1 << 16)
def secret_name(name: str) -> bool:
    """Whether what is assigned to name lets in or signs."""
    words = _words(name)
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _HARMLESS:
        return False
    last = words[-1]
    if "public" in words or last in ("tokens",) and words[:1] in (["max"], ["min"], ["num"]):
        return False
    if last in SECRET_WORDS or last == "auth" and len(words) > 1:
        return True
    if last == "base" and words[-3:-1] == ["secret", "key"]:
        return True
    if last == "key" and len(words) > 1 and words[-2] in KEY_WORDS:
        return True
    if words[-3:] == ["mot", "de", "passe"] or last in ("passe",) and "mot" in words:
        return True
    return bool(_JOINED.search(last)) and "public" not in last


def placeholder(value: str) -> bool:
    return bool(_PLACE.search(value.strip()))


_HEX_TAIL = re.compile(r"^[a-z]+_[a-f]{6}$")


def _random(value: str) -> bool:
    """Whether letters look drawn rather than written: capitals inside of words, with hardly any run of small letters."""
    if not (len(value) >= 10 and re.fullmatch(r"[A-Za-z0-9+/=_\-.!@#$%^&*~]+", value)):
        return False
    runs = re.findall(r"[A-Z][a-z]*", value)
    return len(runs) >= 3 and bool(re.search(r"[a-z]", value)) and sum(len(r) <= 2 for r in runs) >= max(2, len(runs) // 2)


def _mixed(value: str) -> bool:
    """Whether a value without quotes can be a credential rather than a word or an expression."""
    return len(value) >= 4 and (any(c.isdigit() for c in value) or _random(value) or bool(_HEX_TAIL.search(value)))


def literal(value: str, quoted: bool) -> bool:
    """Whether value, assigned to the name of a credential, is one: no placeholder, reference, expression or prose."""
    v = value.strip()
    if len(v) < 4 or placeholder(v) or " " in v and not re.match(r"\S+$", v):
        return False
    if not quoted and (re.search(r"[(){}<>\[\]|`]", v) or not _mixed(v)):
        return False
    if quoted and not any(c.isdigit() for c in v):
        # Words alone are a name or a message; a random string isn't.
        return _random(v) or bool(re.search(r"[!#%^&*]", v) and len(v) >= 8) or bool(re.fullmatch(r"[A-Za-z]{10,}", v) and len(re.findall(r"[A-Z]", v)) >= 2 and re.search(r"[a-z]", v)) or bool(_HEX_TAIL.search(v))
    return True


_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:\\[nr]|[\s\"'`+,#/*;>|\\\-{}<!]|\$\{?|rem |dnl )*(?:[A-Za-z\-]+: [^\n]{1,80}?(?:\\n|\n)[\s#/*;>\-\"'`+]*)*([A-Za-z0-9+/=]{16,})")
_ARMOR_MARKS = r"(?:\\[nr]|[\s\"'`+,#*;>|\\\-]|//|rem |dnl )*"
_ARMOR_LINE = re.compile(rf"{_ARMOR_MARKS}([A-Za-z0-9+/=]+(?:\\[nr][A-Za-z0-9+/=]+)*){_ARMOR_MARKS}")
_ARMOR_HEADER = re.compile(rf"{_ARMOR_MARKS}[A-Za-z\-]+: ")
_ARMOR_TAIL = re.compile(rf"(?:{_ARMOR_MARKS}=[A-Za-z0-9+/]{{4}}(?![\w+/]))?{_ARMOR_MARKS}-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9+.\-]*)://([^\s/?#:@\"'`<>]*):([^\s/?#\"'`]+?)@(?=[^\s\"'`@]*[A-Za-z0-9\[$<{])")
_SIGNED = re.compile(r"(?i)[?&;](?:sig|signature|x-amz-signature|x-goog-signature|x-amz-security-token|token|access_token|auth|api_?key|key|secret|code|password|pwd)=([^\s&\"'`<>;]{8,})")
_HEADER = re.compile(r"(?i)(?<![a-z])(?:authorization[\"'`]?\s*[:=,]\s*[\"'`]?\s*(?:f?[\"'`])?)?(bearer|basic|token|digest)[\s:]+([A-Za-z0-9._~+/=\-]{8,})(?![A-Za-z0-9(<{*])")
_CURL = re.compile(r"(?:\s|^|[\"'`(])(?:-u|--user|--proxy-user)[ =]?[\"']?([^\s:\"'`]+):([^\s\"'`]+)")
_OPTION = re.compile(r"(?:mysql|mysqldump|mariadb|sshpass|mongo|mongosh|redis-cli|plink|pscp)\b[^\n;|&]*?\s(?:-p|-a|-pw)(?:\s+)?[\"']?(?!assw|ort\b|rotocol)([^\s\"'`;|]{4,})")
_FLAG = re.compile(r"--?([^\W\d][\w\-]*)(?:=|\s+)[\"']?([^\s\"'`;|]+)")
_COOKIE = re.compile(r"(?i)\b(?:set-)?cookie[\"']?\s*[:=]\s*[\"']?[^\n\"']*?\b(?:session|sid|sessionid|auth|token|jsessionid|phpsessid)[\w\-]*=([A-Za-z0-9+/=_.%\-]{8,})")
_ASSIGN = re.compile(
    rf"""(?P<q>["'`*]*)(?P<name>{_NAME})(?P<c>["'`*]*\]?[)]?)\s*(?:(?::\s*(?:&?(?:'static\s+)?(?:str|String|string|text|any|Text|CharSequence|Optional\[str\]|varchar\(\d+\)|TEXT))\s*=)|\|\||\?\?|=>|:=|==?|:|,)\s*
    (?:(?P<call>[\w.]+)\()?(?:\(\s*)?(?P<v>[brfuRBFU]{{0,2}}"(?:[^"\\\n]|\\.)*"?|[brfuRBFU]{{0,2}}'(?:[^'\\\n]|\\.)*'?|`[^`\n]*`?|[^\s"'`,;)<>]+)""",
    re.X,
)
_FALLBACK = re.compile(rf"""(?:getenv|environ\.get|env\.get|ENV\.fetch|getProperty|get|getOrDefault|process\.env|setenv|Setenv|putenv|env|put|set|define|setProperty|config)[(\[]\s*["'`](?P<name>{_NAME})["'`]\s*[,\]]\s*(?:\|\|\s*|\)\s*\|\|\s*)?(?P<v>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)""")
_OR = re.compile(rf"""(?P<name>{_NAME})["'`\])]*\s*(?:\|\||\?\?|\bor\b|:-|:=)\s*(?P<v>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s"'`,;)}}]+)""")
_HTML = re.compile(rf"""(?i)\b(?:name|key)=["']?(?P<name>{_NAME})["']?[^<>\n]*?value=["'](?P<v>[^"'\n]+)["']|<(?P<t>{_NAME})>(?P<w>[^<>\s]+)</(?P=t)>|value=["'](?P<u>[^"'\n]+)["'][^<>\n]*?name=["']?(?P<n2>{_NAME})""")
_USE_AS = re.compile(r"(?i)\b(?:use|with|try|nimm|utilise[rz]?|usa)\s+[`\"'](?P<v>[^`\"'\n]+)[`\"']\s+(?:as|for|als|comme|como)\s+(?:the\s+)?(?P<name>(?:[^\W\d]+[ _\-]?){1,5})")
_PROSE = re.compile(r"(?i)(?<!\w)(?:(?:pass ?(?:word|phrase|code)|passwd|pwd|pin code|api[ _]?key|access token|secret|token|credentials?)\s+(?:is|was|are|=|:|to)(?:\s+now)?|(?:kennwort|passwort|mot de passe|contraseña|senha|clave)(?:\s+(?:ist|lautet|est|es|é))?\s*:?|пароль[^:\n]{0,40}:|login\s+\S+\s*/)\s+[`\"']?(?P<v>[^\s`\"'<>]+)")
_TUPLE = re.compile(r"""\b(?:auth|credentials|login|basic_auth)\w*\s*[:=(]+\s*\(?\s*["'`]([^"'`\n]+)["'`]\s*,\s*["'`]([^"'`\n]+)["'`]\s*\)?""")
_CONTINUED = re.compile(r"""\s*(?:\+|\.\.?|&)?[ \t]*\\?\s*(?:\+\s*)?[brfuRBFU]{0,2}(["'`])""")
_KEYED = re.compile(r"(?i)\b(?:accountkey|sharedaccesskey|sharedsecretkey)=([A-Za-z0-9+/=]{16,})")

_LOGIN = re.compile(r"(?i)\b(?:authenticate|log_?in|sign_?in|connect|logon)\(([^()\n]*[\"'`]\s*,\s*)[\"'`]([^\"'`\n]+)[\"'`]\s*\)")
_SQL = re.compile(r"(?i)\b(?:password|identified\s+(?:with\s+\w+\s+)?by(?:\s+password)?)\s+(?:=\s*)?'([^'\n]+)'")
_DOCKER = re.compile(r"(?i)\b(?:docker|podman|helm|az|oc|nerdctl|skopeo|crane|registry|acr|aws|gcloud|npm)\b[^\n;|&]*?\blogin\b[^\n;|&]*?\s(?:-p|--password)(?:=|\s+)[\"']?([^\s\"'`;|]{4,})")
_LOG_IN = re.compile(r"(?i)\b(?:log ?in|sign ?in|login|log on|connect|anmelden|zugang)\s+(?:as|with|als|comme|como)?\s*\S+\s+(?:/|:|with|und|and|mit)\s+([^\s\"'`<>]{4,})")
_PGPASS = re.compile(r"(?<![\w.\-/@])(?:[\w\-]+\.)+[A-Za-z]{2,}:(?:\d{2,5}|\*):[\w\-*]+:[\w\-*]+:([^\s\"'`,;:<>]{4,})")
# Other commands and files that take a password in a place of their own.
_PLACES = [
    re.compile(p)
    for p in (
        r"-pass(?:in|out|word)?\s+pass:([^\s\"';|]{4,})",
        r"\b(?:sqlplus|rman|expdp|impdp|exp|imp)\s+(?:-\w+\s+)*\w+/([^\s@/\"']{4,})@",
        r"\b(?:smbclient|rpcclient|mount\.cifs|net)\b[^\n]*?\s-U\s+[\"']?[\w\\.]+%([^\s\"']{4,})",
        r"\bhtpasswd\s+-\w*b\w*\s+(?:-\w+\s+)*\S+\s+\S+\s+[\"']?([^\s\"']{4,})",
        r"\b(?:zip|unzip|7za?|rar|unrar)\b[^\n|;]*?\s-(?:P\s+|p)([^\s\"'\-]{4,})",
        r"\b(?:requirepass|masterauth|AUTH(?:\s+PLAIN|\s+LOGIN)?)\s+[\"']?([A-Za-z0-9+/=_!@#$%^&*.\-]{6,})",
        r"\becho\s+(?:-\w+\s+)?[\"']?\w+:([^\s\"'|]{4,})[\"']?\s*\|\s*(?:sudo\s+)?chpasswd\b",
        r"\becho\s+(?:-\w+\s+)?[\"']?([^\s\"'|:]{6,})[\"']?\s*\|\s*[^\n]*--password-stdin\b",
        r"/user:\S+\s+[\"']?([^\s\"'/]{4,})",
        r"\b(?:add_user|change_password|set_password)\s+[\"']?\w+[\"']?\s+[\"']?([^\s\"']{4,})",
        r"\bConvertTo-SecureString\s+(?:-String\s+)?[\"']([^\"'\s]{4,})[\"']",
        r"\b(?:ldapsearch|ldapadd|ldapmodify|ldapdelete|ldapwhoami)\b[^\n|;]*?\s-w\s+[\"']?([^\s\"']{4,})",
        r"\b(?:enable|username\s+\S+)\s+(?:secret|password)\s+(?:\d\s+)?([^\s\"']{4,})",
        r"\bsnmp-server\s+community\s+([^\s\"']{4,})",
        r"(?i)\b(?:use|with|try|nimm|nutze)\s+(?:the\s+|this\s+|das\s+)?(?:\w+\s+)?(?:token|password|passphrase|secret|key|passwort|kennwort)\s+[`\"']([^\s`\"']{6,})[`\"']",
        r"\bopenssl\s+enc\b[^\n|;]*?\s-k\s+[\"']?([^\s\"']{4,})",
        r"://([A-Za-z0-9_\-]{20,})@[\w.\-]+",
    )
]
_NETRC = re.compile(r"(?i)\b(?:login|user|account)\s+\S+\s+password\s+[\"']?([^\s\"';]+)")
_BUILDER = re.compile(rf"""\.(?P<name>{_NAME})\(\s*(?P<v>"[^"\n]*"|'[^'\n]*'|`[^`\n]*`)\s*\)""")
_PROPERTY = re.compile(rf"""<\w[^<>\n]*\bname=["'](?P<name>{_NAME})["'][^<>\n]*>(?P<v>[^<>\s]+)</""")
_SPACED = re.compile(rf"(?i)^\W*(?:env|arg|export|set|setx|setenv|define|#define|config set)\s+(?:-\w+\s+)*(?P<name>{_NAME})\s+(?P<v>[^\s=]+)\s*\W*$")
#: A setting and its value in quotes, alone on a line, as build files have them.
_SETTING = re.compile(rf"""^\s*(?P<name>{_NAME})\s+(?P<v>"[^"\n]+"|'[^'\n]+')\s*;?\s*$""")
#: A property by name and value, each in its element.
_ELEMENTS = re.compile(rf"""(?i)<(?:name|key)>\s*(?P<name>{_NAME})\s*</(?:name|key)>\s*<value>\s*(?P<v>[^<>\s]+)\s*</value>""")
#: A variable that is declared in a block with a default.
_DECLARED = re.compile(rf"""\bvariable\s+["'](?P<name>{_NAME})["']\s*\{{[^{{}}]*?\bdefault\s*=\s*(?P<v>"[^"\n]*")""")
_FOR_IS = re.compile(r"(?i)(?<!\w)(?P<name>(?:[^\W\d]+[ _\-]){0,4}?(?:[^\W\d]+))(?:\s+(?:for|of|on|to|in|at|von|für|de|para)\s+(?:the\s+)?[\w.\-/]+)?\s+(?:is|was|ist|lautet|est|es|è|é|jest|är|er)(?:\s+now|\s+still)?\s+[`\"']?(?P<v>[^\s`\"'<>]+)")
_LOOSE = re.compile(r"(?i)(?<!\w)(?:token|password|passwd|secret|api[ _]?key|passphrase|credentials?)\s+[`\"']?(?P<v>[^\s`\"'<>]{6,})[`\"']?\s+(?:works|is valid|expires|still|until|lets|opens|gilt|funktioniert)")

# What the automaton looks for. A hit is necessary for what follows it, never sufficient.
_SPACES = r"[ \t]+"
#: Names: words as they may stand in any name, and last words of names, which no letter lengthens.
NAMES = sorted({*SECRET_WORDS, "passw", "passp", "passc", "passe", "cred", "contrase", "pincode", "pin code", *(k + c + "key" for k in KEY_WORDS for c in ("", " ")), *(c + "key" for c in ("-", "_", ".", "['", '["'))} - {"pass", "pw", "sid"})
LAST_NAMES = ["pass", "pw", "sid"]
#: Places: what goes before or around a value that no name tells of.
PLACES = [
    "://", ":*:", "sig=", "signature=", "bearer", "basic", "-u", "identified", "mysql", "mariadb", "mongo", "redis-cli", "plink", "pscp", "sqlplus", "smbclient", "rpcclient", "htpasswd", "masterauth", "chpasswd", "add_user", "/user:", "convertto-securestring", "ldapsearch", "ldapadd", "ldapmodify", "ldapdelete", "ldapwhoami", "openssl", "snmp-server", "expdp", "impdp", "7za", "requirepass",
    "login", "log in", "log_in", "logon", "log on", "signin", "sign in", "sign_in", "connect(", "anmelden", "zugang",
]
COMMANDS = ["rman", "exp", "imp", "zip", "7z", "rar", "connect"]


def _either(words: list[str]) -> str:
    return "(?i)(?:" + "|".join(re.escape(w) for w in words) + ")"


RULES = {
    "token": [r"(?<![0-9A-Za-z_\-/+])" + form for form in TOKEN_FORMS],
    "piece": [r"[\"'`](?:" + "|".join(map(re.escape, TOKEN_STARTS)) + ")"],
    "armor": ["-----BEGIN"],
    "name": [_either(NAMES), _either(LAST_NAMES) + r"[^A-Za-zÀ-ÿ]", r"(?i)auth(?:[^o]|o[^r]|ori)"],
    "place": [_either(PLACES), _either(COMMANDS) + r"[ \t]", r"[0-9A-Za-z]:[0-9]{2,5}:"],
    "alone": [r"^[^\w\n\"'`$\\]{0,5}[A-Za-z0-9][A-Za-z0-9+/=_\-.!@$%^&*?~]{7,}[ \t]*(?:-->|#\}|\*/)?\r?$"],
    "note": [r"(?i)(?:note|comment|remark|memo|hint|info|description)[\"']?\s*[:=]\s*[\"'][^\"'\s]{8}"],
}


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    """The automaton, once per process: its states are those that texts have needed so far."""
    return Automaton(RULES)


def candidates(texts: list[str]) -> list[dict[int, set[str]]]:
    """Per text: where the lines begin on which something was hit, and what."""
    return automaton().lines(texts)


def anchored_lines(text: str) -> list[tuple[int, int]]:
    """Start and end of each line that grammars are tried on."""
    out = []
    for start, rules in sorted(candidates([text])[0].items()):
        if rules - {"alone", "note"}:
            end = text.find("\n", start)
            out.append((start, len(text) if end < 0 else end))
    return out


def _unquoted(raw: str) -> tuple[str, bool, int]:
    """The value, whether it was quoted, and how far into raw it starts."""
    m = re.match(r"[brfuRBFU]{0,2}([\"'`])", raw)
    if not m:
        return raw, False, 0
    inner = raw[m.end() :]
    return (inner[:-1] if inner.endswith(m[1]) and not inner.endswith("\\" + m[1]) else inner), True, m.end()


Pieces = tuple[tuple[int, int], ...]


def _joined(text: str, end: int) -> tuple[str, list[tuple[int, int]]]:
    """The string pieces that follow the one which ends at end, joined, and where each stands between its quotes."""
    value, pieces = "", []
    while m := _CONTINUED.match(text, end):
        if "\n" not in m[0] and not re.search(r"[+.&]", m[0]):
            break
        close = text.find(m[1], m.end())
        if close < 0 or "\n" in text[m.end() : close]:
            break
        value += text[m.end() : close]
        pieces.append((m.end(), close))
        end = close + 1
    return value, pieces


_KEY_SEGMENT = re.compile(r"[^\"'`\n]+")
_KEY_LEAD = re.compile(r"\s*(?:(?:#+|//+|\*+(?!/)|;+|>+|--(?!-)|rem\b|dnl\b)\s*)*", re.I)


def _key_pieces(text: str, start: int, end: int) -> Pieces:
    """What of a key stands in text[start:end]: its lines without comment marks, quotes and what joins string pieces."""
    out = [(start, start)]
    for m in _KEY_SEGMENT.finditer(text, start, end):
        s, e = m.span()
        if s != start:
            s = min(e, _KEY_LEAD.match(text, s, e).end())
        while e > s and text[e - 1] in " \t\r":
            e -= 1
        if e > s and text[e - 1] == "\\" and text[e : e + 1] in ("\r", "\n", ""):
            e -= 1  # the line goes on
        if e > s and re.search(r"\w|-{5}|=", text[s:e]):
            out.append((s, e))
    return tuple(out[1:]) if out[1:2] and out[1][0] == start else tuple(out)


def _armor_end(text: str, end: int) -> int:
    """Where the key ends whose first line ends at end: after all lines of headers and body that follow, and the END line."""
    at, body = end, False
    while at < len(text):
        stop = text.find("\n", at + 1)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        if m := _ARMOR_END.search(line):
            return at + m.end()
        m = _ARMOR_LINE.fullmatch(line)
        if m and (body or len(m[1]) >= 16):
            end, body = at + m.end(1), True
            if len(m[1]) < 16 and not m[1].startswith("="):
                # The last line of the body; a checksum or the END line may follow.
                tail = _ARMOR_TAIL.match(text, stop)
                return tail.end() if tail else end
        elif line.strip(" \t\r\n#/*;>\"'`+\\-") and (body or not _ARMOR_HEADER.match(line)):
            break
        at = stop
    return end


def _basic(value: str) -> bool:
    """Whether a value of HTTP basic authentication holds a password."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except (binascii.Error, ValueError):
        return False
    user, sep, password = plain.partition(":")
    return bool(sep and len(password) >= 3 and not placeholder(password))


def _line_spans(text: str, at: int, end: int, rules: set[str]) -> list[Pieces]:
    """Absolute spans of the credentials that begin in text[at:end], one line, each with all its pieces."""
    whole: list[Pieces] = []
    out = _simple_spans(text, at, end, rules, whole)
    return [*((span,) for span in out), *whole]


#: The grammars of values in places of their own, tried only where a line holds what they can't do without.
_GRAMMARS = Patterns({
    "url": _URL.pattern, "signed": _SIGNED.pattern, "header": _HEADER.pattern, "curl": _CURL.pattern, "option": _OPTION.pattern, "cookie": _COOKIE.pattern, "keyed": _KEYED.pattern, "tuple": _TUPLE.pattern, "login": _LOGIN.pattern,
    "netrc": _NETRC.pattern, "loose": _LOOSE.pattern, "sql": _SQL.pattern, "docker": _DOCKER.pattern, "log_in": _LOG_IN.pattern, "pgpass": _PGPASS.pattern, "fallback": _FALLBACK.pattern, "or": _OR.pattern, "builder": _BUILDER.pattern, "property": _PROPERTY.pattern,
    "spaced": _SPACED.pattern, "for_is": _FOR_IS.pattern, "html": _HTML.pattern, "use_as": _USE_AS.pattern, "prose": _PROSE.pattern, **{f"place{k}": rx.pattern for k, rx in enumerate(_PLACES)},
}, required_only=True)


def _simple_spans(text: str, at: int, end: int, rules: set[str], whole: list[Pieces]) -> list[tuple[int, int]]:
    """Spans of credentials of one piece; those of several go to whole."""
    line, out = text[at:end], []
    may = _GRAMMARS.names(line.lower())
    if "-----BEGIN" in line:
        for m in _ARMOR.finditer(line):
            if _BODY.match(text, at + m.end()):
                stop = _ARMOR_END.search(line, m.end())
                whole.append(_key_pieces(text, at + m.start(), at + stop.end() if stop else _armor_end(text, end)))
    for m in _TOKEN.finditer(line) if "token" in rules else ():
        if "EXAMPLE" not in m[0] and not re.search(r"[xX]{8}|(.)\1{9}", m[0]):
            out.append((at + m.start(), at + m.end()))
    if "://" in line:
        for m in _URL.finditer(line) if "url" in may else ():
            if not placeholder(m[3]) and (len(m[3]) > 2):
                out.append((at + m.start(3), at + m.end(3)))
        for m in _SIGNED.finditer(line) if "signed" in may else ():
            if not placeholder(m[1]) and (len(m[1]) >= 16 or _mixed(m[1])) and re.search(r"\d", m[1]):
                out.append((at + m.start(1), at + m.end(1)))
    for m in _HEADER.finditer(line) if "header" in may else ():
        v = m[2]
        named = m[0].lower().startswith("authorization")
        if placeholder(v) or m[1].lower() != "basic" and not re.search(r"\d", v) and not _random(v):
            continue
        if m[1].lower() == "basic" and (_basic(v) or named and len(v) >= 16 and re.search(r"\d", v)) or m[1].lower() != "basic" and (named or m[1].lower() == "bearer") and (len(v) >= 16 or named and _mixed(v)):
            out.append((at + m.start(2), at + m.end(2)))
    for name, rx, g in (("curl", _CURL, 2), ("option", _OPTION, 1), ("cookie", _COOKIE, 1), ("keyed", _KEYED, 1), ("tuple", _TUPLE, 2), ("login", _LOGIN, 2)):
        for m in rx.finditer(line) if name in may else ():
            if not placeholder(m[g]) and len(m[g]) >= 4 and (rx is not _LOGIN and g == 2 or re.search(r"\d", m[g]) or _random(m[g])) and not re.search(r"[(){}<>$]", m[g]):
                out.append((at + m.start(g), at + m.end(g)))

    def named_value(name: str, start: int, stop: int, known: bool = False) -> None:
        raw = text[start:stop]
        value, quoted, skip = _unquoted(raw)
        if not quoted:
            value = value.rstrip(".,;:!?*").rstrip("-") if not value.endswith("==") else value
            value = re.sub(r"(?:-->|#\}|\*/|\"\}?)$", "", value)
        if "://" in line and "&" in value:
            value = value[: value.index("&")]  # the next parameter of a link
        more: list[tuple[int, int]] = []
        if quoted:
            first = (start + skip, start + skip + len(value))
            if value.endswith("\\") and text[stop : stop + 1] in ("\n", "\r"):
                value = value[:-1]
                first = (first[0], first[1] - 1)
            rest, more = _joined(text, stop)
            value += rest
        if (known or secret_name(name)) and literal(value, quoted):
            whole.append((first, *more)) if more else out.append((start + skip, start + skip + len(value)))
        elif more and value.startswith(tuple(TOKEN_STARTS)) and _TOKEN.fullmatch(value):
            whole.append((first, *more))

    named = "name" in rules or "piece" in rules
    for grammar, rx in (("", _ASSIGN), ("fallback", _FALLBACK), ("or", _OR)) if named else ():
        if grammar and grammar not in may:
            continue
        pos = 0
        while m := rx.search(line, pos):
            pos = max(m.start("v"), m.start() + 1)
            name = m["name"]
            if rx is _ASSIGN and m[0][m.end("c") - m.start() :].lstrip().startswith(",") and not (m["c"].strip("])") and m["v"][:1] in "\"'`"):
                continue  # the next argument of a call, not a value
            named_value(name, at + m.start("v"), at + m.end("v"))
    for grammar, rx in (("builder", _BUILDER), ("property", _PROPERTY), ("spaced", _SPACED), ("for_is", _FOR_IS)) if named else ():
        for m in rx.finditer(line) if grammar in may else ():
            if rx is _PROPERTY:
                if secret_name(m["name"]) and literal(m["v"], True):
                    out.append((at + m.start("v"), at + m.end("v")))
            elif rx is _FOR_IS:
                v = m["v"].rstrip(".,;:)")
                if literal(v, False) and secret_name(m["name"].strip().replace(" ", "_")):
                    out.append((at + m.start("v"), at + m.start("v") + len(v)))
            else:
                named_value(m["name"], at + m.start("v"), at + m.end("v"))
    for grammar, rx in (("netrc", _NETRC), ("loose", _LOOSE), ("sql", _SQL), ("docker", _DOCKER), ("log_in", _LOG_IN), ("pgpass", _PGPASS)):
        for m in rx.finditer(line) if grammar in may else ():
            v = m[1]
            if literal(v, False) or re.search(r"\d", v) and literal(v, True):
                out.append((at + m.start(1), at + m.end(1)))
    for k, rx in enumerate(_PLACES):
        for m in rx.finditer(line) if f"place{k}" in may else ():
            v = m[1]
            if literal(v, False) or re.search(r"\d", v) and literal(v, True) and not re.search(r"[(){}<>]", v):
                if rx is not _PLACES[-1] or re.search(r"\d", v) and re.search(r"[A-Z]", v) and re.search(r"[a-z]", v):
                    out.append((at + m.start(1), at + m.end(1)))
    m = "auth" in line and re.search(r"[\"']auth[\"']\s*:\s*[\"']([A-Za-z0-9+/=]{8,})[\"']", line)
    if m and _basic(m[1]):
        out.append((at + m.start(1), at + m.end(1)))
    for m in _HTML.finditer(line) if "html" in may else ():
        for n, v in (("name", "v"), ("t", "w"), ("n2", "u")):
            if m[n] and m[v] and secret_name(m[n]) and literal(m[v], True):
                out.append((at + m.start(v), at + m.end(v)))
    for m in _USE_AS.finditer(line) if "use_as" in may else ():
        name = re.sub(r"\s+(?:until|till|bis|for|while|when|in)\b.*", "", m["name"], flags=re.I).strip()
        if secret_name(name) and literal(m["v"], True):
            out.append((at + m.start("v"), at + m.end("v")))
    for m in _PROSE.finditer(line) if "prose" in may else ():
        v = m["v"].rstrip(".,;:)")
        if literal(v, False) or len(v) >= 6 and re.search(r"\d", v) and literal(v, True):
            out.append((at + m.start("v"), at + m.start("v") + len(v)))
    for m in _FLAG.finditer(line) if named and "-" in line else ():
        if secret_name(m[1]) and literal(m[2], False):
            out.append((at + m.start(2), at + m.end(2)))
    if named:
        m = _SETTING.match(line)
        if m and secret_name(m["name"]):
            named_value(m["name"], at + m.start("v"), at + m.end("v"))
        for m in _ELEMENTS.finditer(text, at, end) if "<" in line else ():
            if secret_name(m["name"]) and literal(m["v"], True):
                out.append((m.start("v"), m.end("v")))
        m = "variable" in line and _DECLARED.match(text, at + line.index("variable"))
        if m and secret_name(m["name"]):
            named_value(m["name"], m.start("v"), m.end("v"))
    # A list of name and value pairs, each on its line: the value stands on the next.
    m = re.match(rf"""\s*-?\s*["']?(?:name|key)["']?\s*[:=]\s*["']?(?P<name>{_NAME})["']?,?\s*$""", line)
    if m and secret_name(m["name"]):
        n = re.compile(r"""\r?\n\s*["']?value["']?\s*[:=]\s*(?P<v>"[^"\n]*"|'[^'\n]*'|[^\s,]+)""").match(text, end)
        if n:
            named_value(m["name"], n.start("v"), n.end("v"))
    # Seen from the value, where only that line has an anchor.
    m = re.match(r"""\s*-?\s*["']?value["']?\s*[:=]\s*(?P<v>"[^"\n]*"|'[^'\n]*'|\S+)""", line)
    if m and at:
        before = text[text.rfind("\n", 0, at - 1) + 1 : at - 1]
        n = re.search(rf"""name["']?\s*[:=]\s*["']?(?P<name>{_NAME})""", before)
        if n:
            named_value(n["name"], at + m.start("v"), at + m.end("v"))
    # The value stands on the next line: name = ( newline "piece".
    m = re.search(rf"""(?P<name>{_NAME})["'`\]]*\s*(?:=|:|:=|=>)\s*[(\[]?\s*\\?\r?$""", line)
    if m and secret_name(m["name"]):
        n = re.compile(r"""\r?\n\s*(?P<v>"[^"\n]*"|'[^'\n]*'|`[^`\n]*`)""").match(text, end)
        if n:
            named_value(m["name"], n.start("v"), n.end("v"))
    return out


# A value that stands alone on its line, but for the marks of a comment or a list.
_ALONE = re.compile(r"^[^\w\n\"'`$\\]{0,5}([A-Za-z0-9][A-Za-z0-9+/=_\-.!@$%^&*?~]{7,})[ \t]*(?:-->|#\}|\*/)?\r?$", re.M)
_PASSWORD_SHAPES = re.compile(r"[a-z]{3,}(?:-[a-z]{3,}){1,3}-\d{1,3}|[a-z]{3,}_[0-9a-f]{6}|[A-Z][a-z]{2,}\d{2,4}[a-z]{3,}|[A-Z][a-z]{2,}[.!_@][a-z]{3,}\d{2,4}|[a-z]{3}[!$%?*][A-Z]{4}\d{2}[!$%?*]")
_NOTE = re.compile(r"(?i)[\"']?\b(?:note|comment|remark|memo|hint|info|description)[\"']?\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)


def _drawn_alone(v: str) -> bool:
    """Whether a value without any context has the shape of a password or was drawn: capitals, small letters and digits mixed."""
    if _PASSWORD_SHAPES.fullmatch(v):
        return True
    if re.search(r"ABCDE|abcde|01234|12345|56789", v):
        return False
    if _random(v) and len(v) >= 12 and v.isalnum():
        return True
    mixed = re.search(r"[A-Z]", v) and re.search(r"[a-z]", v) and re.search(r"\d", v)
    if not mixed or len(v) < 11 or placeholder(v) or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v):
        return False
    # Words with digits, paths and alphabets have long runs of one kind; drawn values change kind all the time.
    kinds = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", v)))
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return changes >= 0.3 * len(v)


_DATA = re.compile(r"[^\w\n\"'`$\\]{0,5}[A-Za-z0-9+/=]{60,}[ \t]*\r?")


def _in_data(text: str, start: int, end: int) -> bool:
    """Whether a long line goes on in the line before or after it: encoded data, where no value stands alone."""
    if end - start < 60:
        return False
    before = text[text.rfind("\n", 0, max(0, start - 1)) + 1 : max(0, start - 1)]
    stop = text.find("\n", end + 1)
    after = text[end + 1 : len(text) if stop < 0 else stop]
    return bool(_DATA.fullmatch(before) or _DATA.fullmatch(after))


def _alone(text: str, lines: dict[int, set[str]]) -> list[tuple[int, int]]:
    """Spans of values that stand alone on a line, or are all that a note says, outside of key armor and certificates."""
    found = []
    for start, rules in lines.items():
        if "alone" in rules:
            m = _ALONE.match(text, start)
            if m and _drawn_alone(m[1]) and not _in_data(text, *m.span()):
                found.append(m.span(1))
        if "note" in rules:
            # The name may stand on the line before.
            end = text.find("\n", start)
            before = text.rfind("\n", 0, max(0, start - 1)) + 1
            found += [m.span(1) for m in _NOTE.finditer(text, before, len(text) if end < 0 else end) if m.start(1) >= start and _drawn_alone(m[1])]
    if not found or "-----BEGIN" not in text:
        return found
    blocks = [m.span() for m in _BLOCK.finditer(text)]
    return [(s, e) for s, e in found if not any(a <= s < b for a, b in blocks)]


def credentials(text: str | None, lines: dict[int, set[str]] | None = None) -> list[Pieces]:
    """The literal credentials in text, in order, each the spans of its pieces; of those that overlap, the first and longest counts.

    lines: what the automaton hit, where it went over many texts at once. Null and empty texts have none. The length
    of a text isn't limited.
    """
    if not text:
        return []
    found: set[Pieces] = set()
    lines = candidates([text])[0] if lines is None else lines
    for start, rules in lines.items():
        if rules - {"alone", "note"}:
            end = text.find("\n", start)
            found.update(_line_spans(text, start, len(text) if end < 0 else end, rules))
    found.update((span,) for span in _alone(text, lines))
    out: list[Pieces] = []
    for pieces in sorted(found, key=lambda x: (x[0][0], -x[-1][1])):
        if pieces[-1][1] > pieces[0][0] and (not out or pieces[0][0] >= out[-1][-1][1]):
            out.append(pieces)
    return out


def spans(text: str | None) -> list[tuple[int, int]]:
    """From where to where each credential in text reaches, with what stands between its pieces."""
    return [(pieces[0][0], pieces[-1][1]) for pieces in credentials(text)]


def lines_of(text: str, where: list[Pieces]) -> list[int]:
    """The 1-based lines on which credentials begin, each once."""
    out, line, at = [], 1, 0
    for pieces in where:
        s = pieces[0][0]
        line, at = line + text.count("\n", at, s), s
        if not out or out[-1] != line:
            out.append(line)
    return out


def redact(text: str, where: list[Pieces], mark: str = "<REDACTED>") -> str:
    """text with the first piece of each credential replaced and its other pieces emptied.

    Quotes, keys, line ends, comment marks and what joins the pieces still stand.
    """
    parts, at = [], 0
    for pieces in where:
        for k, (s, e) in enumerate(pieces):
            parts += [text[at:s], "" if k else mark]
            at = e
    return "".join([*parts, text[at:]])
