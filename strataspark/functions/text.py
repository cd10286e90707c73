"""Text columns: hashes, cuts, names, templates, paths. Lengths are bytes of UTF-8."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits in bytes and characters.
EMBED_BYTES, DIFF_BYTES, CONDENSED_BYTES, SLUG_CHARS, CHUNK_BYTES = 30_720, 40_000, 280, 80, 600_000
#: Words that show what a query is for, in order of the intents.
INTENTS = {
    "research": ("how does", "what is", "why does", "explain", "understand", "research", "investigate", "explore", "describe", "overview", "tell me about", "what are"),
    "build": ("code", "implement", "build", "write", "create", "add", "fix", "develop", "modify", "want to code", "working on", "using the", "change", "update"),
    "review": ("review", "evaluate", "check", "assess", "audit", "is this correct", "does this work", "should i", "is this right"),
}


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def truncate_utf8(text: Column, size: int = EMBED_BYTES) -> Column:
    """The longest prefix of at most ``size`` bytes that is whole characters."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.substring(raw, 1, max(0, size - k)) for k in range(4)]
    out = F.lit("")
    for cut in reversed(cuts):
        out = F.when(F.is_valid_utf8(cut.cast("string")), F.try_validate_utf8(cut.cast("string"))).otherwise(out)
    return F.when(F.octet_length(text) <= size, text).otherwise(out)


def truncate_ellipsis(text: Column, size: int, mark: str = "...") -> Column:
    """Texts over ``size`` bytes cut so that with the mark they have ``size``."""
    return F.when(F.octet_length(text) > size, F.concat(truncate_utf8(text, size - len(mark)), F.lit(mark))).otherwise(text)


def truncate_diff(diff: Column, size: int = DIFF_BYTES) -> Column:
    return F.when(F.octet_length(diff) > size, F.concat(truncate_utf8(diff, size), F.lit("\n\n... [diff truncated]"))).otherwise(diff)


def condense(text: Column, size: int = CONDENSED_BYTES) -> Column:
    """The first paragraph with more than heading lines, without these, on one line, cut at a space before ``size`` bytes."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = F.transform(
        F.split(text, "\n\n"),
        lambda p: F.array_join(F.filter(F.split(trim(p), "\n"), lambda line: ~F.startswith(trim(line), F.lit("#"))), " "),
    )
    bare = F.transform(body, lambda p: F.regexp_replace(trim(p), " {2,}", " "))
    # a paragraph of headings alone has no lines left, as has an empty one; one whose other lines are blank counts
    kept = F.filter(F.zip_with(F.split(text, "\n\n"), bare, lambda p, b: F.struct(p.alias("p"), b.alias("b"))), lambda x: (trim(x["p"]) != "") & F.exists(F.split(trim(x["p"]), "\n"), lambda line: ~F.startswith(trim(line), F.lit("#"))))
    first = F.get(kept, F.lit(0))["b"]
    head = truncate_utf8(first, size)
    at = F.char_length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.size(kept) == 0, trim(text)).when(F.octet_length(first) > size, F.concat(cut, F.lit("…"))).otherwise(first)


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, SLUG_CHARS)


def doc_output_name(name: Column, doc_id: Column, modified: Column) -> Column:
    return F.concat(F.substring(modified, 1, 10), F.lit("_"), slug(name), F.lit("__"), doc_id, F.lit(".md"))


def parse_remote(url: Column) -> Column:
    """``owner/repo`` of a repository URL, https or ssh; empty where there is none."""
    ssh = F.regexp_extract(url, r"^[^:]*:(.*)$", 1)
    web = F.regexp_extract(url, r"^[^/]*/[^/]*/[^/]*/(.+)$", 1)
    path = F.when(~F.startswith(url, F.lit("http")) & F.contains(url, F.lit(":")), ssh).otherwise(web)
    path = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), "/$", "")
    return F.when(F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit(""))) == 1, path).otherwise("")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression of whole paths: ``*`` and ``?`` stay within a segment, a segment ``**`` stands for any number of them."""
    out, first = "", True
    parts = [p for i, p in enumerate(glob.replace("\\", "/").strip("/").split("/")) if p or i == 0]
    segments = [p for i, p in enumerate(parts) if not (p == "**" and i and parts[i - 1] == "**")]
    for i, part in enumerate(segments):
        if part == "**":
            last = i == len(segments) - 1
            out += (".*" if first else "(?:/.*)?") if last else ("(?:[^/]+/)*" if first else "(?:/[^/]+)*")
            if first and not last:
                continue
        else:
            piece = "".join({"*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t)) for t in re.findall(r"\[[^\]]+\]|.", part))
            out += ("" if first or out.endswith("/)*") else "/") + piece
        first = False
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    return F.rlike(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), F.lit(glob_regex(glob)))


def path_accepted(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Matches some include (or there is none) and no exclude."""
    ok = F.lit(not include)
    for g in include or []:
        ok = ok | glob_match(path, g)
    for g in exclude or []:
        ok = ok & ~glob_match(path, g)
    return ok


def ext_match(path: Column, extensions: list[str] | None = None) -> Column:
    """The extension, whatever its case, is one of these; of none given, ``.md``."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin([e.lower() for e in extensions or [".md"]])


def base64_to_hex(text: Column) -> Column:
    """Decoded and in hex; what is no base64 stays."""
    ok = F.rlike(text, F.lit("^[A-Za-z0-9+/]*={0,2}$")) & (F.octet_length(text) % 4 == 0)
    return F.when(ok, F.coalesce(F.lower(F.hex(F.try_to_binary(text, F.lit("base64")))), text)).otherwise(text)


def otlp_value(string_value: Column, int_value: Column, bool_value: Column) -> Column:
    return F.coalesce(string_value, int_value.cast("string"), bool_value.cast("string"), F.lit(""))


def span_text(service: Column, name: Column, start_nano: Column, end_nano: Column, status: Column) -> Column:
    ms = F.expr("cast(null as bigint)")
    delta = end_nano.cast("long") - start_nano.cast("long")
    ms = F.when(delta >= 0, F.floor(delta / 1_000_000)).otherwise(F.ceil(delta / 1_000_000)).cast("string")
    state = F.when(status == 1, "OK").when(status == 2, "ERROR").otherwise("UNSET")
    return F.concat(F.lit("["), service, F.lit("] span: "), name, F.lit(" duration="), ms, F.lit("ms status="), state)


def extract_patch(text: Column) -> Column:
    """What stands in the first ``<patch>`` element, trimmed; empty without one."""
    return F.regexp_replace(F.regexp_extract(text, r"(?s)<patch>(.*?)</patch>", 1), r"^\s+|\s+$", "")


def detect_intents(query: Column) -> Column:
    """Intents whose words occur, in fixed order; ``build`` where none does."""
    q = F.lower(query)
    found = [F.when(F.rlike(q, F.lit("|".join(map(re.escape, words)))), F.lit(name)) for name, words in INTENTS.items()]
    out = F.array_compact(F.array(*found))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("build")))


def split_tags(tags: Column) -> Column:
    return F.transform(F.split(tags, ","), lambda t: F.trim(t))


def issue_text(number: Column, state: Column, title: Column, repo: Column, labels: Column, url: Column, body: Column) -> Column:
    return F.format_string("GitHub Issue #%d [%s]: %s\n\nRepo: %s\nState: %s\nLabels: %s\nURL: %s\n\n%s", number, state, title, repo, state, labels, url, F.trim(body))


def comment_text(repo: Column, number: Column, author: Column, body: Column) -> Column:
    return F.format_string("Comment on %s#%d by %s:\n\n%s", repo, number, author, F.trim(body))


def file_list_text(paths: Column) -> Column:
    """One text for a sorted array of paths."""
    return F.concat(F.lit("Files touched:\n"), F.array_join(F.transform(paths, lambda p: F.concat(F.lit("  "), p, F.lit("\n"))), ""))


def split_chunks(path: Column, content: Column, max_bytes: int = CHUNK_BYTES) -> Column:
    """Parts of a document: at top headings (.md), at ``---`` lines (.yaml), else one; parts over ``max_bytes`` cut between lines.

    Lines are folded from the left into whole parts; a line longer than the limit is a part of its own.
    """
    kind = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    lines = F.split(content, "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    start = F.expr("named_struct('done', cast(array() as array<string>), 'now', '')")

    def fold(parts: Column, cut, drop) -> Column:
        def step(acc, line):
            flush = cut(acc["now"], line)
            done = F.when(flush, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
            kept = F.when(flush, "").otherwise(acc["now"])
            return F.struct(done.alias("done"), F.when(flush & drop(line), kept).otherwise(F.concat(kept, line, F.lit("\n"))).alias("now"))

        return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))

    never = lambda line: F.lit(False)
    headed = fold(lines, lambda now, line: F.startswith(line, F.lit("# ")) & (now != ""), never)
    yaml = fold(lines, lambda now, line: (F.regexp_replace(line, "[ \t]+$", "") == "---") & (now != ""), lambda line: F.lit(True))
    yaml = F.when(F.size(yaml) == 0, F.array(content)).otherwise(yaml)
    parts = F.when(kind.isin(".md", ".markdown"), headed).when(kind.isin(".yaml", ".yml"), yaml).otherwise(F.array(content))

    def window(part):
        own = F.split(F.regexp_replace(part, "\n$", ""), "\n")
        full = lambda now, line: (now != "") & (F.octet_length(now) + F.octet_length(line) + 1 > max_bytes)
        return F.when(F.octet_length(part) <= max_bytes, F.array(part)).otherwise(fold(own, full, never))

    return F.flatten(F.transform(parts, window))


#: What a model is asked, in our own words; ``{text}`` is where the text goes.
PROMPTS = {
    "importance": "How important is this note to remember, from 1 to 10? Answer with the number alone.\n\n{text}",
    "tags": "Give three to five topics of this note as a JSON array of lower-case strings, and nothing else.\n\n{text}",
    "valence": "How did what this note tells turn out, from -1.0 (failed) over 0.0 (nothing to tell) to 1.0 (worked)? Answer with the number alone.\n\n{text}",
    "facts": "List the facts that this document states as a JSON array of self-contained sentences.\n\n{text}",
    "cluster": "Sum up these notes, which belong together, in a few sentences. Keep names and decisions.\n\n{text}",
    "skill": "These notes show the same thing again and again. Write down the reusable technique.\n\n{text}",
    "wisdom": "Make a general rule of this technique. Answer as a JSON object with rule, tags and domain.\n\n{text}",
    "seed": "Find rules and skills in these notes. Answer as a JSON object with rules (strings) and skills (objects with content and tags).\n\n{text}",
    "expand": "Write three other ways to ask this, as a JSON array of strings.\n\n{text}",
    "classify": "Which one of the allowed values fits this note? Answer with the value alone.\n\n{text}",
    "brief": "Say in one or two sentences what this note is about.\n\n{text}",
    "pull_request": "Say in two to four sentences what this merged change did and why, naming files and values.\n\n{text}",
}


def prompt(kind: str, text: Column) -> Column:
    before, after = PROMPTS[kind].split("{text}")
    return F.concat(F.lit(before), text, F.lit(after))


def pull_request_text(repo: Column, scope: Column, author: Column, title: Column, body: Column, diff: Column) -> Column:
    """What is shown of a change: where, who, title, then description and diff if there are any."""
    part = lambda label, c, end: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(label), F.trim(c), F.lit(end))).otherwise("")
    return F.concat(
        F.lit("Repo: "), repo, F.lit("\n"), part("Scope: ", scope, "\n"), F.lit("Author: "), author, F.lit("\nTitle: "), title, F.lit("\n\n"),
        part("Description:\n", body, "\n\n"), F.when(F.coalesce(diff, F.lit("")) != "", F.concat(F.lit("Diff:\n"), truncate_diff(diff))).otherwise(""),
    )
