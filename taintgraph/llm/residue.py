"""Template residue, filler, error pages and demands for scripts.

Lines are normalised (blanks, case) and counted by host over distinct texts. A line that recurs in a large part of a host's texts is its
boilerplate and is subtracted before a text is judged: by the lower end of the interval for its share, so that a line of
three texts needs to stand in all three, and one of a thousand in little more than the share; small hosts need no rule
of their own. Two things are never subtracted, however often they recur. One is a slot, filler or an error message: copies of an
error page, or of a template with an open slot, are evidence each. What is subtracted with the plain lines are the demands for scripts that pages carry for
readers without them, as lines or noscript elements. The other is all of a document: a text that holds nothing but recurrent lines is judged whole.

What remains is read sentence by sentence: a sentence is evidence when it holds an unfilled slot, filler, a note to fill
in later, an error message or a demand for scripts, unless the sentence only talks about such a thing (it says so
itself, or stands in quotation marks within other words).

Most documents hold nothing of the kind. They leave first, by a linear-time match of the same patterns without their
side conditions, over Arrow batches; the sentences of the others pass the same match before the patterns themselves are tried. The few
boilerplate lines per host are joined to the candidates only.

Defined cases: null, empty and blank texts are never found; a null host is a host of its own; repeated documents come
out once per id; texts of any length are read whole; empty tables give empty results; extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgraph.llm.batches import parts as parts_of

#: words of the customary filler text (fixed values)
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()

#: an unfilled slot, by the notations of common template languages and spreadsheets
SLOT = [
    r"\{\{\{?\s*[#/^>&!]?\s*[\w.\- |]+\}?\}\}",
    r"\{%[^%\n]{1,80}%\}",
    r"<%[=\-]?[^%\n]{1,80}%>",
    r"\$\{[^}\n]{1,60}\}",
    r"#\{[A-Za-z_][\w.]{1,40}\}",
    r"%\([A-Za-z_]\w*\)[sdfr]",
    r"%%[A-Za-z_]{2,40}%%|%[A-Z]{2,}(?:_[A-Z]+)+%",
    r"(?<![\\A-Za-z_^$\]}])\{(?:[a-z][a-z0-9_.]{1,40}|[A-Z]{2,}(?:_[A-Z]+)*|\d{1,2})\}",
    r"(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*[A-Z0-9]__(?![A-Za-z0-9_])",
    r"@@[A-Za-z_]{2,40}@@",
    r"\[\[\s*[A-Za-z_][\w ]{1,40}\]\]",
    r"\[(?i:insert|enter|add|your|put|type|fill|choose|select)\b[^\]\n]{0,60}\]",
    r"\[[^\]\n]{0,60}(?i:goes here|to be (?:added|filled|completed|confirmed|determined|inserted|supplied)|tbd|tba|placeholder)\s*\]",
    r"<(?i:your|insert|enter|add)[ _][^<>\n]{1,60}>",
    r"<(?!/?(?i:noscript|script|style|html|head|body|title|div|span|pre|code|img|table|tbody|thead|form|input|button|strong|small|sub|sup|link|meta|main|nav|section|article|aside|footer|header|label|option|select|textarea|iframe|svg|video|audio|font|center|blockquote|em|br|hr|li|ul|ol|dl|dt|dd|td|tr|th|h\d)\b)[A-Za-z]{2,}(?:[ _][A-Za-z]+){0,4}>",
    r"<title>(?! *[^<\n]{1,200}</title>)",
    r"«[A-Za-z][\w ]{1,40}»",
    r"\(null\)|\[object Object\]|#REF!|#NAME\?|#VALUE!|#DIV/0!|#N/A",
    r"(?<![A-Za-z0-9])(?:NaN|undefined|XXX+|TBD|TBA|TBC|YYYY-MM-DD)(?![A-Za-z0-9])",
    r"(?<![\w.])\?{3,}(?!\w)",
    r"(?<![\w$\\])\$(?:[A-Z]{4,}|[A-Z]+(?:_[A-Z]+)+)\$(?![\w$])",
]

#: the same word over and over; it refers back to itself, so the linear-time matcher cannot read it
REPEATED = r"(?i:(?<![\w-])([a-z]{2,12})(?:[ \t]+\1){3,}(?![\w-]))"

#: filler, or a note that content is to come
FILLER = [
    rf"(?i:(?:\b(?:{'|'.join(LOREM)})\b[\s,.;]*){{5,}})",
    REPEATED,
    r"(?i)(?<![\w-])(?:asdf|sdfg|hjkl|qwert[yz]|azerty)+(?![\w-])",
    r"(?i)\b(?:text|content|description|abstract|summary|title|name|caption|paragraph|introduction)s? (?:goes?|will go|comes?) here\b",
    r"(?i)\byour (?:own )?(?:introduction|text|content|description|abstract|summary|title|name|caption|paragraph)s? (?:goes )?here\b",
    r"(?i)\b(?:content|page|section|details|more|text|description|information) (?:is |are )?coming soon\b|\bcoming soon\W*$",
    r"(?i)\bplaceholder (?:page|text|paragraph|content|image|title|section)\b",
    r"(?i)\b(?:blank|empty) template\b|\bfill (?:this |it |me )?in (?:before|later|when)\b",
    r"(?i)\bclick here to (?:edit|add|change)\b|\breplace this (?:paragraph|text|section|sentence|line|block)\b",
    r"(?i)\bthis (?:page|section|paragraph|text|field) (?:is |has been )?(?:intentionally left blank|to be (?:written|completed|filled))",
    r"\b(?:TODO|FIXME)\b\s*[:\-(]|(?i)\bto be (?:written|filled in|completed|added) (?:later|here|soon)\b",
    r"(?i)\bescriba aqu[ií]\b|\btexto de (?:ejemplo|relleno)\b|\bcontenido (?:próximamente|en preparación)",
    r"(?i)\btexte? (?:à|a) compl[ée]ter\b|\bvotre texte ici\b|\bcontenu à venir\b",
    r"(?i)\bhier steht (?:später|bald|noch|demnächst)\b|\bhier (?:text|inhalt) (?:einfügen|eingeben)\b|\b(?:platzhalter|blind)text\b|\binhalt folgt\b",
    r"ここに[^。\n]{0,20}(?:入力|記入|記述|入ります)|準備中です|ダミーテキスト|後で(?:記入|追記)",
]

#: error messages
ERROR = [
    r"Traceback \(most recent call last\)|^\s*File \"[^\"\n]+\", line \d+|^\s*(?:[A-Z]\w*(?:Error|Exception)): ",
    r"(?i)\b(?:40[0-9]|41[0-9]|42\d|50[0-9])\b\W{0,3}(?:not found|bad gateway|bad request|forbidden|unauthori[sz]ed|internal server error|service (?:temporarily )?unavailable|gateway time-?out|gone|too many requests|method not allowed|request time-?out|seite nicht gefunden)",
    r"(?i)\bHTTP(?: Status| Error)? ?[45]\d\d\b|\bType Status Report\b|\berror (?:code|id|ref(?:erence)?|number)\W{0,3}[0-9a-f]{3,}",
    r"(?i)\binternal server error\b|\bthe server encountered\b|\bbad gateway\b|\bgateway time-?out\b|\bservice (?:is )?(?:temporarily )?unavailable\b|^\s*bad request\b",
    r"(?i)\bconnection (?:was )?(?:reset|refused|timed out|closed)\b|\brequest (?:timed out|failed)\b|\bquery failed\b|\bupstream (?:returned|connect|request|store)\b",
    r"(?i)\b(?:page|resource|path|file|url|record|entry|document)\b[^.\n]{0,60}\b(?:was not found|could not be found|cannot be found|does not exist|no longer exists?|is no longer available)\b",
    r"(?i)\bcan(?:'|’)?t find (?:that|this|the) page\b|\bthe link you followed\b|\bunable to (?:load|display|open) (?:the |this )?page\b|\bpage load error\b",
    r"(?i)^\W*(?:access denied|permission denied|not authori[sz]ed|unauthori[sz]ed|forbidden)\b|\byou (?:don(?:'|’)t|do not) have permission\b|\byou are not (?:allowed|authori[sz]ed|permitted) to\b",
    r"(?i)\btoo many requests\b|\btry again (?:in \d+|later|shortly)\b|\bretry (?:after|in) \d+ (?:seconds|minutes)\b|\bquota exceeded\b|\brate limit exceeded\b",
    r"(?i)^\W*oops\b|\bwhoops\b|\bsomething (?:went wrong|broke)\b|\bwe hit a snag\b|\ban? (?:unexpected|unknown|internal) error (?:has )?occurred\b|\bour team has been notified\b",
    r"(?i)\bcould not render\b|\bunexpected token\b|\bvalue is null\b|\bundefined is not\b|\bcannot read propert|\bdivision by zero in\b|\bwarning: [^\n]{1,80} on line \d+|\bfatal error\b[^\n]{0,80} on line",
    r"(?i)\bestablishing a database connection\b|\brelation \"[^\"\n]+\" does not exist\b|\bsyntax error at or near\b|\bdid not answer in time\b|\bunder maintenance\b|\bsegmentation fault\b",
    r"(?i)\bsession has expired\b|\bplease (?:log|sign) in (?:again )?to (?:view|continue|see|access)\b|\bchecking your browser\b|\bunusual traffic\b|\bare you a robot\b|\bconfirm (?:that )?you are (?:a )?human\b",
    r"\{\s*\"(?:error|errors|code|status)\"\s*:\s*(?:\{|[45]\d\d\b|\"[^\"]*(?:error|exceed|denied|not found)|\[)",
    r"(?i)\bcontact the administrator\b|\bgo back to the start page\b",
    r"(?i)\bseite nicht gefunden\b|\bein (?:interner |unerwarteter )?fehler ist aufgetreten\b|\bzugriff verweigert\b|\bderzeit nicht erreichbar\b|\bversuchen sie es später\b|\bexistiert nicht oder wurde\b",
    r"(?i)\bune erreur\b[^.\n]{0,30}\b(?:produite|survenue)|\baccès refusé|\bpage n(?:'|’)existe (?:plus|pas)|\bpage (?:introuvable|non trouvée)|\bveuillez réessayer|\bserveur (?:est )?(?:indisponible|ne répond pas)",
    r"(?i)\bse ha producido un error\b|\bacceso denegado\b|\bservidor no responde\b|\bpágina no encontrada\b|\bvuelva a intentarlo\b|\bha ocurrido un error\b",
    r"エラーが発生しました|ページが見つかりません|アクセスが拒否|しばらくしてから(?:もう一度|再度)|サーバーに接続できません",
]

#: demands for scripts
SCRIPTS = [
    r"(?i)\b(?:enable|activate|allow|turn on|switch on|requires?|needs?|necesita|requiert|nécessite|benötigt|erfordert|activer|aktivieren sie|active|activar|habilite|habilitar)\b[^.\n]{0,25}\b(?:java ?scripts?|scripts|scripting)\b",
    r"(?i)\b(?:java ?scripts?|scripts|scripting)\b[^.\n]{0,25}\b(?:is|are|has been|must be|to be|wird|ist|est|está)\b[^.\n]{0,15}\b(?:disabled|switched off|turned off|blocked|required|allowed|enabled|off|benötigt|deaktiviert|désactivé|desactivado|required)\b",
    r"(?i)\bturn java ?script on\b|\bscripting (?:is )?(?:switched|turned) off\b|\bhas scripting\b[^.\n]{0,20}\boff\b|\buntil scripts are\b|\bwithout (?:scripts|java ?script)(?: enabled)?\b|<noscript>",
    r"(?i)java ?script を?有効|java ?script が(?:無効|必要)",
]

#: the sentence talks about such a thing instead of being one
DISCUSSED = [
    r"(?i)\b(?:written|taken|kept|printed|read) literally\b|\bplaceholders? (?:like|such as)\b|\bfor example\b|\be\.g\.|\bso-called\b|\bsuch as [{$%_\[<“\"]",
    r"(?i)\b(?:generator|template engine|renderer|loader|macro|exporter|parser|config file|configuration|format string|the string|syntax|notation|escapes? it)\b",
    r"(?i)\b(?:as intended|is returned by|returned by the|is defined as|by convention|stands for|denotes?)\b",
    r"(?i)\b(?:went back to the|typed the value in|values? (?:is |are )?(?:given )?above|as a dash|by hand|sheet showed|in the draft|first layout|former|earlier (?:version|portal|layout)|was replaced by|were replaced|are replaced)\b",
    r"(?i)\b(?:all tables of|can be read without|works without|is static|not needed)\b",
    r"(?i)\b(?:we|i|one) (?:traced|patched|fixed|saw|got|asked|hit(?! a snag)|found|noticed|renewed)\b|\bannotator asked\b|\btraceback ended\b|\bafter the patch\b|\bpatched the\b",
    r"(?i)\b(?:was|were) (?:retried|repeated|asked again|fetched again|tried again)\b|\bretried (?:once|twice|three|\d+)|\brates? of the\b[^.\n]{0,40}\bfell\b|\bpages? answered\b|\bcame through\b",
    r"(?i)\bkam zuerst\b|\bder zweite versuch\b|\bwurde (?:erneut|wiederholt) abgerufen\b|\bau deuxième essai\b|\ben el segundo intento\b",
]

KINDS = {"slot": SLOT, "filler": FILLER, "error": ERROR, "scripts": SCRIPTS}


#: an element that pages carry for readers without scripts
NOSCRIPT = r"(?is)<noscript[^>]*>.*?</noscript>"
#: two-sided 95 per cent
Z = 1.959964


def _norm_line(c: Column) -> Column:
    """A line as it is counted. Numbers stay: lines that differ in them hold different content."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _norm_element(c: Column) -> Column:
    """An element as it is counted; numbers in it are ids of the page."""
    return F.regexp_replace(_norm_line(c), r"\d+", "0")


def _elements(c: Column) -> Column:
    return F.when(F.contains(F.lower(c), F.lit("<noscript")), F.array_distinct(F.regexp_extract_all(c, F.lit(NOSCRIPT), F.lit(0)))).otherwise(F.array().cast("array<string>"))


def _lines(c: Column) -> Column:
    return F.filter(F.split(c, r"[\r\n]+"), lambda p: F.trim(p) != "")


def _joined(parts: list[str]) -> str:
    return "|".join(parts)


def _exact(parts: list[str]) -> regex.Pattern:
    """The parts as one pattern; from the first part that ignores case on, all do."""
    out, fold = [], False
    for p in parts:
        fold |= "(?i)" in p
        out.append(f"(?{'i' if fold else ''}:{p.replace('(?i)', '')})")
    return regex.compile("|".join(out))


def without_conditions(pattern: str) -> str:
    """The pattern without look-arounds, line anchors and word ends (engines differ on those next to letters beyond
    ASCII): it matches wherever the pattern does, and more."""
    out, i = [], 0
    in_class = False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append("" if pattern[i + 1] == "b" else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "^$":
            i += 1
            continue
        elif pattern.startswith(("(?<=", "(?<!", "(?=", "(?!"), i):
            depth, j, inner = 0, i, False
            while True:
                d = pattern[j]
                if d == "\\":
                    j += 2
                    continue
                if inner:
                    inner = d != "]"
                elif d == "[":
                    inner = True
                elif d == "(":
                    depth += 1
                elif d == ")":
                    depth -= 1
                    if not depth:
                        break
                j += 1
            i = j + 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wide = [without_conditions(_joined([p for p in parts if p != REPEATED])) for parts in KINDS.values()]
    again = re.compile(REPEATED)
    for b in batches:
        text = b.column("text")
        hit = pa.array([again.search(t) is not None for t in text.to_pylist()], pa.bool_())
        for p in wide:
            hit = pc.or_(hit, pc.match_substring_regex(text, p))
        yield b.filter(hit)


#: a mention in quotation marks within other words
_QUOTED = regex.compile(r"(?<=\w )“[^”\n]{1,80}”(?= \w)")
_SENTENCES = regex.compile(r"\n+|(?:(?<=[.!?;])|(?<=[^\"]:)|(?<=[.!?;:][)”’\"']))\s+(?=[\p{Lu}\p{N}<\[{(“«\"$@_+-])|(?<=。)")
_FOUND = pa.schema([("doc_id", pa.int64()), *[(k, pa.bool_()) for k in KINDS]])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, kinds) of the texts (doc_id, t) with a sentence that is evidence."""
    wide = {k: without_conditions(_joined([p for p in parts if p != REPEATED])) for k, parts in KINDS.items()}
    exact, discussed, again = {k: _exact(parts) for k, parts in KINDS.items()}, _exact(DISCUSSED), re.compile(REPEATED)
    for batch in batches:
        for b in parts_of(batch, ["t"], 2048, 2_000_000):
            sentences, owner = [], []
            for k, t in enumerate(b.column("t").to_pylist()):
                mine = [x for x in _SENTENCES.split(_QUOTED.sub(" ", t)) if x]
                sentences += mine
                owner += [k] * len(mine)
            every, flags = pa.array(sentences, pa.string()), {k: np.zeros(b.num_rows, bool) for k in KINDS}
            talk: dict[int, bool] = {}
            for kind, pattern in wide.items():
                maybe = pc.match_substring_regex(every, pattern).to_numpy(zero_copy_only=False)
                if kind == "filler":
                    maybe |= np.fromiter((again.search(x) is not None for x in sentences), bool, len(sentences))
                for i in np.flatnonzero(maybe).tolist():
                    if exact[kind].search(sentences[i]):
                        if i not in talk:
                            talk[i] = discussed.search(sentences[i]) is not None
                        flags[kind][owner[i]] |= not talk[i]
            keep = np.logical_or.reduce(list(flags.values()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).filter(pa.array(keep)), *[pa.array(f[keep]) for f in flags.values()]], schema=_FOUND)


def lower_share(k: Column, n: Column) -> Column:
    """Lower end of the Wilson interval for k of n."""
    p, z2 = k / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def host_boilerplate(docs: DataFrame, share: float = 0.3) -> DataFrame:
    """(host, line): hashes of normalised lines and noscript elements that stand in at least ``share`` of a host's
    distinct texts, by the lower end of the interval.

    Counts are over distinct texts, by their hashes, and are partial sums before the last shuffle."""
    d = docs.select("host", F.xxhash64("text").alias("h"), "text")
    units = F.array_distinct(F.concat(F.transform(_elements("text"), lambda x: F.xxhash64(_norm_element(x))), F.transform(_lines("text"), lambda x: F.xxhash64(_norm_line(x)))))
    n = d.select("host", "h").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    seen = d.select("host", "h", F.explode(units).alias("line")).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    # no line in under the share of the texts can reach it; the join is with one row per host
    got = seen.join(n, seen["host"].eqNullSafe(n["host"]))
    return got.where(lower_share(F.col("n"), F.col("n_docs")) >= share).select(seen["host"], "line")


def residue(docs: DataFrame, share: float = 0.3, subtract: bool = True) -> DataFrame:
    """(doc_id, slot, filler, error, scripts): documents with evidence, and of which kinds.

    ``docs``: doc_id, host, text. ``subtract=False`` leaves the boilerplate in, to see what it changes."""
    d = docs.where("text is not null and trim(text) <> ''").select(F.col("doc_id").cast("long"), "host", "text")
    c = d.mapInArrow(_candidates, d.schema)
    whole = F.regexp_replace("text", r"[\r\n]+", "\n")
    if not subtract:
        return c.select("doc_id", whole.alias("t")).mapInArrow(_judge, "doc_id long, slot boolean, filler boolean, error boolean, scripts boolean").distinct()
    lines = host_boilerplate(d, share).groupBy("host").agg(F.collect_set("line").alias("boiler"))  # few: each is in a share of the host's texts
    x = c.join(lines, c["host"].eqNullSafe(lines["host"]), "left").select("doc_id", "text", "boiler")
    kept = _joined(SLOT) + "|" + _joined(FILLER) + "|" + _joined(ERROR)
    recurs = lambda u: F.array_contains("boiler", F.xxhash64(_norm_line(u)))
    plain = F.aggregate(F.filter(_elements("text"), lambda e: F.array_contains("boiler", F.xxhash64(_norm_element(e)))), F.col("text"), lambda t, e: F.replace(t, e, F.lit("\n")))
    content = F.exists(_lines(plain), lambda p: ~recurs(p))
    rest = F.array_join(F.filter(_lines(plain), lambda p: ~recurs(p) | p.rlike(kept)), "\n")
    t = F.when(F.col("boiler").isNull() | ~content, whole).otherwise(rest)
    return x.select("doc_id", t.alias("t")).mapInArrow(_judge, "doc_id long, slot boolean, filler boolean, error boolean, scripts boolean").distinct()
