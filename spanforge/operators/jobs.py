"""Jobs, domain schemas and question files: the parts that run on the driver over short lists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ("ok", "skipped", "failed")


def run_jobs(jobs: list[dict], work: Callable[[str, dict], str]) -> list[dict]:
    """Jobs first in, first out; each file has its own status, and a job with a failed file is failed."""
    out = []
    for job in sorted(jobs, key=lambda j: (j["created_at"], j["id"])):
        files = []
        for f in job["files"]:
            if f.get("status") in ("ok", "skipped"):
                files.append(f)
                continue
            try:
                files.append({**f, "status": work(f["path"], job), "error": None})
            except Exception as e:  # noqa: BLE001  told in the file's status
                files.append({**f, "status": "failed", "error": str(e)})
        out.append({**job, "files": files, "status": "failed" if any(f["status"] == "failed" for f in files) else "done"})
    return out


def retry(job: dict, skipped: bool = False) -> dict:
    """The job with its failed files, and skipped ones if asked, pending again."""
    again = ("failed", "skipped") if skipped else ("failed",)
    return {**job, "status": "pending", "files": [{**f, "status": "pending", "error": None} if f.get("status") in again else f for f in job["files"]]}


def last_status(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """(key, status, n): every item's last status and how many transitions it had."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias("status"), F.count("*").alias("n"))


#: What frames the sections of a schema's prompts.
RULE, RULES_TITLE, PROPERTY_RULES_TITLE = "━", "EXTRACTION RULES:", "KEY RULES FOR PROPERTIES:"
ENTITY_TITLE, RELATION_TITLE, TYPES_LABEL = "ENTITY TYPES YOU MUST EXTRACT:", "COMMON rel_type VALUES:", "example type values:"
CLASS = re.compile(r"[A-Z][A-Z0-9_]*")
PROPERTY_HEAD = re.compile(r"For ([A-Z_][A-Z0-9_]*), consider:")
RELATION_HEAD = re.compile(r"(\S.*?)\s*↔\s*(.+?):")


def _is_rule(line: str) -> bool:
    return set(line.strip()) == {RULE}


def _framed(prompt: str, title: str) -> list[list[str]]:
    """The paragraphs between a title with its rule and the rule above the extraction rules; none without that frame."""
    lines = (prompt or "").split("\n")
    starts = [i + 2 for i in range(len(lines) - 1) if lines[i].rstrip().endswith(title) and _is_rule(lines[i + 1])]
    ends = [i for i in range(len(lines) - 1) if _is_rule(lines[i]) and lines[i + 1].startswith(RULES_TITLE)]
    if not starts or not any(e >= starts[0] for e in ends):
        return []
    found = [[]]
    for line in lines[starts[0] : next(e for e in ends if e >= starts[0])]:
        if line.strip():
            found[-1].append(line.strip())
        elif found[-1]:
            found.append([])
    return [f for f in found if f]


def parse_entities(prompt: str) -> list[dict]:
    """Entity classes of a prompt: {class, description, types}."""
    out = []
    for head, *body in _framed(prompt, ENTITY_TITLE):
        if CLASS.fullmatch(head):
            types = [x.removeprefix(TYPES_LABEL) for x in body if x.startswith(TYPES_LABEL)]
            said = [x for x in body if not x.startswith(TYPES_LABEL)]
            out.append({"class": head, "description": " ".join(said), "types": [t.strip() for t in (types or [""])[-1].split("|") if t.strip()]})
    return out


def parse_properties(prompt: str) -> dict[str, list[dict]]:
    """By entity class, the properties {name, hint} that are listed under `For CLASS, consider:`."""
    out: dict[str, list[dict]] = {}
    now = None
    for line in (prompt or "").split("\n"):
        head = PROPERTY_HEAD.match(line)
        bullet = re.fullmatch(r"\s*- (?:(\w+)\s*(?:\((.*)\))?|(.+?))\s*", line, re.A)
        if head or _is_rule(line):
            now = head and head[1]
        elif now and bullet:
            out.setdefault(now, []).append({"name": bullet[1] or bullet[3], "hint": bullet[2] or ""})
    return out


def parse_relationships(prompt: str) -> list[dict]:
    """Pairs of classes and the relationship types between them: {a, b, types}."""
    heads = [(RELATION_HEAD.fullmatch(p[0]), p[1:]) for p in _framed(prompt, RELATION_TITLE)]
    return [{"a": h[1], "b": h[2], "types": [t.strip() for t in " ".join(body).split(",") if t.strip()]} for h, body in heads if h]


def _cut(prompt: str, end: str) -> tuple[str, str]:
    """A prompt before and from the rule above the title `end`; the rest is empty without one."""
    at = prompt.find(f"\n{end}")
    if at < 0:
        return prompt, ""
    above = prompt.rfind("\n", 0, at)
    return (prompt[:above], prompt[above:]) if above >= 0 and _is_rule(prompt[above + 1 : at]) else (prompt[:at], prompt[at:])


def _blocks(prompt: str, head: Callable[[str], tuple[str, ...] | None], end: str | None) -> list[tuple[tuple[str, ...], str]]:
    """(classes, text) of the blocks that begin with a head, each up to the next; with no `end`, up to the first line that isn't indented."""
    found: list[tuple[tuple[str, ...], list[str]]] = []
    is_open = False
    for line in (_cut(prompt, end)[0] if end else prompt).split("\n"):
        names = head(line)
        if names:
            found.append((names, [line]))
            is_open = True
        elif is_open and (end or line.startswith("  ")):
            found[-1][1].append(line)
        else:
            is_open = False
    return [(names, "\n".join(lines).rstrip()) for names, lines in found if end or len(lines) > 1]


def _entity_head(line: str) -> tuple[str, ...] | None:
    return (line,) if re.fullmatch(r"[A-Z_][A-Z0-9_]*", line) else None


def _property_head(line: str) -> tuple[str, ...] | None:
    found = PROPERTY_HEAD.fullmatch(line)
    return found and (found[1],)


def _relation_head(line: str) -> tuple[str, ...] | None:
    found = re.fullmatch(r"([A-Z_][A-Z0-9_]*) ↔ ([A-Z_][A-Z0-9_]*):", line)
    return found and (found[1], found[2])


#: How each prompt is cut into blocks, and before which title new ones go.
PROMPT_PARTS = {
    "entities_prompt": (_entity_head, RULES_TITLE, RULES_TITLE),
    "properties_prompt": (_property_head, PROPERTY_RULES_TITLE, PROPERTY_RULES_TITLE),
    "relationships_prompt": (_relation_head, None, RULES_TITLE),
}


def harmonise(child: dict, parent: dict) -> tuple[dict, list[str]]:
    """The child schema with the entity classes that only its parent has, and the classes added.

    Their prompt blocks come along, in the order of the classes, into the prompts that the child
    has; a relationship's block comes once, for either end.  Doing it twice adds nothing.
    """
    missing = sorted(set(parent.get("entity_types", [])) - set(child.get("entity_types", [])))
    if not missing:
        return child, []
    out = {**child, "entity_types": sorted({*child.get("entity_types", []), *missing})}
    for prompt, (head, end, before) in PROMPT_PARTS.items():
        if prompt not in child:
            continue
        theirs = _blocks(parent.get(prompt, ""), head, end)
        extra = list(dict.fromkeys(text for name in missing for names, text in theirs if name in names))
        if extra:
            first, rest = _cut(child[prompt], before)
            out[prompt] = "\n\n".join([first + ("" if rest else "\n\n"), *extra]) + ("\n\n" + rest if rest else "")
    return out, missing


#: The labels of a question and of what its judge is told.
ASKED, JUDGED = re.compile(r"(?i)\*\*Question:?\*\*\s*"), re.compile(r"(?i)\*\*Evaluation comment:?\*\*\s*")


def _labelled(text: str) -> tuple[str, str | None]:
    """A question after its label, and the comment to it or None."""
    parts = JUDGED.split(text, maxsplit=1)
    return parts[0].strip(), (parts[1].strip() or None) if len(parts) > 1 else None


def _by_heading(text: str):
    """(title, body) of all headings."""
    heads = [*re.finditer(r"(?m)^#{1,6}[^\S\n]+(.*)$", text)]
    ends = [h.start() for h in heads[1:]] + [len(text)]
    return [(h[1].strip(), text[h.end() : e].strip()) for h, e in zip(heads, ends, strict=False)]


def parse_questions(text: str) -> list[dict]:
    """Questions of a file as {seq, qid, title, question, eval_comment}, by the first rule that finds any.

    Headings with a labelled question; labels anywhere; headings with a text; lines that end in a
    question mark.  An id such as Q7 comes from the title, or else from the place.
    """
    body = (text or "").replace("\r\n", "\n")
    heads = _by_heading(body)

    def labelled_headings():
        for title, part in heads:
            cut = ASKED.split(part, maxsplit=1)
            if len(cut) > 1:
                asked = _labelled(cut[1])[0]
                comment = JUDGED.split(part, maxsplit=1)[1:]
                yield title, asked, (comment[0].strip() or None) if comment else None

    def labels():
        for part in ASKED.split(body)[1:]:
            yield (None, *_labelled(part))

    def headings():
        for title, part in heads:
            yield title, part, None

    def lines():
        for line in body.split("\n"):
            bare = line.strip().lstrip("-*0123456789. ").strip()
            yield None, bare if bare.endswith("?") else "", None

    for rule in (labelled_headings, labels, headings, lines):
        found = [x for x in rule() if x[1]]
        if found:
            break
    out = []
    for seq, (title, asked, comment) in enumerate(found, 1):
        number = re.search(r"(?i)\bQ(\d+)\b", title or "")
        bare = re.sub(r"(?i)^Q\d+\s*[—\-:]\s*", "", title or "").strip()
        out.append(
            {"seq": seq, "qid": f"Q{int(number[1]) if number else seq:02d}", "title": bare or title, "question": asked, "eval_comment": comment}
        )
    return out
