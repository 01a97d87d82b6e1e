"""Template residue, filler and error or script notices in place of content, judged by their surroundings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.htmlruns import Run, body_of, runs_of, shown
from pagewright.llm.main_content import fetched, inputs, shared_forms, site_runs, with_shared

#: A message stands in place of content where less prose than this stands in its block and beside it.
MAX_PROSE_WORDS = 60
#: Filler is the content where at least this share of the page's prose is filler.
FILLER_SHARE = 0.5
MAX_COMMON_WORDS = 1_000_000

_BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 td th pre blockquote section article main body dd dt figcaption center tr ul ol table form".split())
_FURNITURE = frozenset("nav header footer aside".split())
_CODE = frozenset("pre code samp kbd".split())

# ---- fixed values: grammars of placeholders by their delimiters ---------------------------------------------------
_FIELD = r"[A-Za-z][\w\-]*(?:\s*[.:_|\s]\s*[A-Za-z][\w\-]*)*"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_FIELD}\s*\}}\}}|\{{%-?\s*{_FIELD}\s*-?%\}}|\$\{{\s*{_FIELD}\s*\}}|<%=?\s*{_FIELD}\s*%>|\[\[\s*{_FIELD}\s*\]\]|@@\s*{_FIELD}\s*@@|%%?[A-Za-z]+(?:[_-][A-Za-z]+)+%%?|(?<!\w)__[A-Za-z]+(?:[_-][A-Za-z]+)*__(?!\w)|"
    rf"(?<!\w)XX[A-Za-z]+-[A-Za-z_]+XX(?!\w)|(?<![\w$\{{])\{{[A-Za-z]+(?:[_.][A-Za-z]+)+\}}|\[(?:INSERT|ENTER|YOUR|ADD|TBD|PLACEHOLDER)\b[^\]\n]{{0,60}}\]|(?<!\w)(?:TODO|FIXME|TBD):\s|<[A-Za-z]+ (?:first_)?[A-Za-z_]+>|#\{{\s*{_FIELD}\s*\}}"
)
UNSET = re.compile(r"\[object Object\]|(?<![\w'\"‘“])(?:undefined|NaN|null|\(none\)|\(null\)|\(undefined\)|None(?= (?:euros|dollars|items)))(?![\w'\"’”])")
#: Words by which a sentence explains a placeholder or a value instead of having one left in it.
EXPLAINS = re.compile(
    r"\bstands? for\b|\bexpands?\b|\bplaceholders?\b|\bsyntax\b|\bvariables?\b|\bmail template\b|\bmailer\b|\bshell\b|\bfills? in\b|\bmerge fields?\b|\bescape\b|\bliteral\b|\bin the (?:script|template|code|config\w*|manual)\b|\bfor example\b|"
    r"\bterms\b|\bkeyword\b|\breturns\b|\bplatzhalter\b|\bsteht für\b|\bmarcador\b|\bsignifie\b|\bsignifica\b|\bwrite [{$\[<%@]",
    re.I,
)
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit "
    "voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim laborum vitae ligula sapien quam dictum semper porta nunc feugiat arcu cursus varius pretium rutrum "
    "massa lacus tellus mollis ornare vestibulum vivamus mauris nec pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas".split()
)
FILLER = re.compile(
    r"^(?:this is (?:a |some )?(?:placeholder|dummy|sample|filler|example) (?:paragraph|text|copy|content)|blind text\b|dummy text\b|your (?:text|headline|content|description|title)\b.* (?:goes )?here|add (?:a|your) (?:short )?(?:description|text)\b.*\b(?:for your|here)|"
    r"(?:replace|edit) this (?:text|paragraph)|insert (?:your )?text|sample text|blindtext|hier steht (?:ihr|dein) text|texte d.exemple|texto de (?:ejemplo|relleno)|click to (?:edit|add) )",
    re.I,
)
MESSAGE = re.compile(
    r"^(?:error:? ?)?404\b|^error [A-Z0-9_\-]*\d[A-Z0-9_\-]*:|(?:did|does) not (?:answer|respond)\b.{0,60}in time|timed out\b|(?:page|site|document|file|address)\b.{0,80}(?:could not|can't|cannot) be found|(?:page|file|document) not found|nothing (?:here|(?:was )?found|matches)\b|no (?:results|matches|records)\b|wurde (?:leider )?nicht gefunden|\bintrouvable\b|n'a pas été trouvée?|n'existe (?:pas|plus)|no (?:se )?(?:ha )?(?:podido )?encontr\w+|no existe\b|"
    r"^(?:error:? ?)?(?:403 )?access (?:is )?denied|acceso denegado|zugriff verweigert|ist gesperrt|accès (?:refusé|interdit)|(?:do not|don't) have permission|(?:session|link) has expired|sitzung .{0,60}abgelaufen|sesión .{0,60}(?:caduc|expir)\w+|session .{0,60}expiré|"
    r"checking your browser|(?:confirm|verify|prove) (?:that )?you are (?:a )?human|not a robot|unusual traffic|wir prüfen ihren browser|überprüfen .{0,40}browser|vérification .{0,40}navigateur|comprobando .{0,40}navegador|sicherheitsprüfung|"
    r"down for maintenance|wartungsarbeiten|(?:in|wegen) wartung|wird (?:gerade )?gewartet|en mantenimiento|en maintenance|maintenance en cours|back (?:shortly|soon)|coming soon|come back later|(?:site|page|shop|area)\b.{0,60}under construction|im aufbau|en construc(?:ción|tion)|bientôt (?:disponible|de retour)|próximamente|demnächst|in kürze|"
    r"something went wrong|unhandled exception|null (?:reference|pointer)|query failed|headers already sent|cannot (?:modify|send) headers?|(?:fatal|parse|syntax) error|stack ?trace\b|\"status\": ?\"error\"|(?:not|cannot be) (?:rendered|displayed)|default (?:web )?page\b|internal server error|service (?:is )?(?:temporarily )?unavailable|bad gateway|too many requests|gateway time-?out|"
    r"(?:enable|turn on|switch on|activate|allow) (?:java ?scripts?|scripts|cookies)|(?:without|needs?|requires?) (?:java ?scripts?|scripts)\b|(?:switch|turn) (?:java ?scripts?|scripts|cookies|them|it) on|aktivieren sie .{0,20}(?:java ?script|cookies)|activ(?:ez|er|e|ar) .{0,20}(?:java ?script|cookies)|habilit[ea]r? .{0,20}(?:java ?script|cookies)|blocks cookies|"
    r"(?:java ?scripts?|scripts|cookies) (?:is|are|must be) (?:required|needed|necessary|enabled|disabled)|(?:java ?script|cookies) (?:wird |werden )?benötigt|(?:nécessite|necesita|requiere) .{0,20}(?:java ?script|cookies)|(?:java ?script|cookies)\b.{0,20}(?:nécessaires?|requis|necesari[oa]s?|obligatori)",
    re.I | re.S,
)
#: One of these is in every text that MESSAGE finds; they are looked for first because that is much faster.
_MESSAGE_HINTS = (
    "404", "in time", "timed out", "found", "nothing", "no results", "no matches", "no records", "gefunden", "trouv", "encontr", "exist", "denied", "denegado", "verweigert", "gesperrt", "refus", "interdit", "permission", "expired", "abgelaufen", "caduc", "expir", "browser", "navigateur", "navegador",
    "human", "robot", "unusual traffic", "sicherheitspr", "maintenance", "wartung", "gewartet", "mantenimiento", "back shortly", "back soon", "coming soon", "come back", "construc", "aufbau", "bientôt", "próximamente", "demnächst", "in kürze", "went wrong",
    "exception", "null reference", "null pointer", "query failed", "header", "error", "trace", "rendered", "displayed", "default page", "default web page", "unavailable", "bad gateway", "too many", "time-out", "timeout", "script", "cookies", "turn them on", "turn it on", "switch them on", "switch it on",
)
# ---- end of fixed values ------------------------------------------------------------------------------------------
#: Sentences of words only, each from a capital to a stop.
_SPOKEN = re.compile(r"(?:[^\W\d_a-zß-ÿ][^\W\d_]*(?:,? [^\W\d_]+){2,40}[.!?]\s*)+")
_HINTS = ("{", "[", "%", "@@", "__", "XX", "<", "TODO", "FIXME", "TBD", "undefined", "null", "NaN", "(none)", "None")
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.S | re.I)
_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Þ\"'„¿¡(\[{<$%@])")
_QUOTED = re.compile(r"['\"‘’“”„«»]([^'\"‘’“”„«»]{2,60})['\"‘’“”„«»]")
_LETTERS = re.compile(r"[^\W\d_]+")


def content_blocks(runs: list[Run], of_site: list[bool] | None = None) -> list[tuple[str, bool, bool]]:
    """(text, in code, whether all of it is of the site) of the page's blocks outside navigation elements; the runs of one
    block are joined. of_site: the runs that many pages share."""
    out, last = [], None
    for run, common in zip(runs, of_site or [False] * len(runs)):
        names = [x.partition(".")[0] for x in run.path]
        if _FURNITURE.intersection(names):
            continue
        block = next((n for n, x in zip(reversed(run.nodes), reversed(names)) if x in _BLOCKS), 0)
        if block == last and out:
            out[-1][0] += " " + shown(run.text)
            out[-1][3] &= common
        else:
            out.append([shown(run.text), bool(_CODE.intersection(names)), names[-1:] == ["a"], common])
        last = block
    return [(t, code, common) for t, code, link, common in out if not (link and t.count(" ") < 9)]


def _prose_words(text: str) -> int:
    """Words of a block if it reads like sentences: eight words or more, mostly lower case, ended or long."""
    words = text.split()
    if len(words) < 8:
        return 0
    letters = _LETTERS.findall(text)
    if len(letters) > 1.5 * len(words):  # code, traces, lists of addresses
        return 0
    spoken = len(letters) if text.isupper() else sum(map(str.islower, letters))
    return len(words) if spoken >= 0.55 * len(words) and (text.rstrip()[-1:] in ".!?…:" or len(words) > 20) else 0


def _message(text: str) -> re.Match | None:
    low = text.lower()
    return MESSAGE.search(text) if any(h in low for h in _MESSAGE_HINTS) else None


def _is_filler(text: str) -> bool:
    if text.count(" ") < 12 and FILLER.search(text):
        return True
    letters = text.lower().split()
    return len(letters) >= 4 and sum(w.strip(".,;:!?") in LATIN for w in letters) >= 0.6 * len(letters)


def residue_of_blocks(blocks: list[tuple[str, bool, bool]], common: frozenset[str]) -> tuple[str | None, int]:
    """(what stands in place of content: placeholder, unset, filler, notice, or None; words of prose beside it).

    A message counts by its surroundings: neither its block nor the rest of the page may hold as much prose as
    MAX_PROSE_WORDS. Blocks of the site are no prose of the page, but may be its message."""
    strange: list[str] = []
    filler = prose = messages = left = unset = 0
    for text, code, of_site in blocks:
        words = _prose_words(text)
        is_filler = _is_filler(text)
        if is_filler:
            words = words or text.count(" ") + 1
            filler += words
        elif common and words:
            letters = [w.lower() for w in _LETTERS.findall(text)]
            if _SPOKEN.fullmatch(text) and sum(w in common for w in letters) < 0.05 * len(letters):
                strange += letters
        # A page with enough prose has content whatever messages it holds, so it isn't searched for more of them.
        if prose < MAX_PROSE_WORDS and words < MAX_PROSE_WORDS:
            m = _message(text)
            if m and not (len(m[0]) > 3 and not text.startswith("{") and any(m[0] in q for q in _QUOTED.findall(text))):
                messages += 1
                continue
        if not of_site or is_filler:
            prose += words
        if code or not any(h in text for h in _HINTS):
            continue
        for sentence in _SENTENCES.split(text):
            if EXPLAINS.search(sentence) and len(PLACEHOLDER.findall(sentence)) < 3:
                continue
            left += len(PLACEHOLDER.findall(sentence))
            unset += len(UNSET.findall(sentence))
    if left:
        return "placeholder", prose
    if unset:
        return "unset", prose
    if len(strange) >= 20 and len(set(strange)) <= 0.6 * len(strange):
        filler += len(strange)
    if filler and filler >= FILLER_SHARE * prose:
        return "filler", prose
    if messages and prose < MAX_PROSE_WORDS:
        return "notice", prose
    return None, prose


def residue_of(html: str, common: frozenset[str] = frozenset(), runs: list[Run] | None = None, of_site: list[bool] | None = None) -> str | None:
    """What stands in place of content in a page: placeholder, unset, filler, notice; None for a page with content.

    common: frequent words of the languages that pages are written in. Sentences without any, made of few words again and
    again, are filler in an invented language."""
    blocks = content_blocks(runs_of(html) if runs is None else runs, of_site)
    found, prose = residue_of_blocks(blocks, common)
    if found is None and prose < 8 and not any(t.count(" ") > 3 for t, *_ in blocks):
        for m in _NOSCRIPT.finditer(body_of(html)):
            note = shown(re.sub(r"<[^>]*>", " ", m[1]))
            if _message(note) and not re.match(r"some\b", note, re.I):
                return "notice"
    return found


def residue_of_text(text: str, common: frozenset[str] = frozenset()) -> str | None:
    """As residue_of, for an extracted text: its lines are the blocks, the marks of headings left out."""
    lines = [shown(line.lstrip("#")) for line in text.split("\n")]
    return residue_of_blocks([(x, False, False) for x in lines if x], common)[0]


_FOUND = "page_id long, residue string"


def residue_pages(pages: DataFrame, common_words: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(page_id, residue) of the fetched pages whose main content is residue, by their html or their extracted text.

    pages: page_id, url, status, html; extracted: page_id, text; common_words: word, a small table that the driver reads.
    Only status 200 counts; null and empty html and texts and pages without any text or notice don't come out. Lines that
    many pages of a host or many hosts share, counted over all pages, are no prose. An extracted text counts for what it
    says as a whole, filler or a notice, which html with much furniture may hide; placeholders in it only where there is
    no html, as it no longer tells code. Rows with the same page_id are judged each and come out once a kind. Without
    common words no filler in invented languages is found."""
    rows = common_words.select(F.lower(F.trim("word")).alias("w")).where("w <> ''").distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    common = frozenset(r["w"] for r in rows)

    def named(found):
        found = [(i, r) for i, r in found if r]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string())], ["page_id", "residue"])

    def judge(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                own = zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), *inputs(b))
                yield named((i, residue_of(html, common, runs, site_runs(runs, host, shared))) for i, html, runs, host, shared in own)

    def judge_text(batches):
        for b in batches:
            yield named((i, residue_of_text(t, common)) for i, t in zip(b.column("page_id").to_pylist(), b.column("text").to_pylist()))

    found = with_shared(fetched(pages), shared_forms(pages)).mapInArrow(judge, _FOUND)
    if extracted is not None:
        good = pages.where("status = 200 AND page_id IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max((F.length("html") > 0).cast("int")).alias("has_html"))
        texts = extracted.where("page_id IS NOT NULL AND text <> ''").select(F.col("page_id").cast("long").alias("page_id"), F.col("text").cast("string").alias("text"))
        by_text = texts.mapInArrow(judge_text, _FOUND).join(good, "page_id").where("residue IN ('filler', 'notice') OR coalesce(has_html, 0) = 0")
        found = found.unionByName(by_text.select("page_id", "residue"))
    return found.distinct()


def without_residue(texts: DataFrame, pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """The rows of texts (page_id, text) whose page isn't residue; rows without a fetched page stay."""
    found = residue_pages(pages, common_words, texts).select(F.col("page_id").alias("_residue")).distinct()
    return texts.join(found, F.col("page_id") == F.col("_residue"), "left_anti")
