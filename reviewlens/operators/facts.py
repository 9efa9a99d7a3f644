"""Code facts from source text: types, methods, calls, flow; and their resolution across files.

No Java grammar is available here, so the Java provider is a tokenizer over a documented subset:
packages, imports, types with their parents, fields, methods and constructors, calls, control flow,
local variables and field access. A file that it can't balance gives a ``parse_error`` row and no facts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.functions.text import count_of

FACTS = "file_path string, kind string, ord int, name string, owner string, type string, detail string, names array<string>, start_line int, end_line int"

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|&&|\|\||[+\-*/%&|^=!<>]=|\+\+|--|\S", re.S)
# The language's words.
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
TYPES = frozenset(("class", "interface", "enum", "record"))
FLOW = {"if": "IF", "for": "FOR", "while": "WHILE", "do": "DO_WHILE", "try": "TRY_CATCH", "switch": "SWITCH", "synchronized": "SYNCHRONIZED"}
NOT_CALLED = frozenset("if for while switch catch synchronized return new super this throw assert try do else case".split())


#: A file without any of these as a word has no facts, so its tokens needn't be read; a token ends where this does.
_FACTUAL = re.compile(r"(?:package|import|class|interface|enum|record)(?![\w$])")


class JavaFacts:
    """One pass over a file's tokens with a stack of open braces."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, int]] = []
        line, last = 1, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", last, m.start())
            last = m.start()
            if not m[0].startswith(("//", "/*")):
                self.tokens.append((m[0], line))
        self.rows: list[dict] = []
        self.text_lines = text.split("\n")

    def add(self, kind, name, owner="", type_="", detail="", names=(), start=0, end=0):
        self.rows.append({"kind": kind, "ord": len(self.rows), "name": name, "owner": owner, "type": type_, "detail": detail, "names": list(names), "start_line": start, "end_line": end})
        return self.rows[-1]

    def close_of(self, i: int, opens: str, closes: str) -> int:
        depth = 0
        for k in range(i, len(self.tokens)):
            t = self.tokens[k][0]
            depth += (t == opens) - (t == closes)
            if not depth:
                return k
        raise ValueError(f"unbalanced {opens} at line {self.tokens[i][1]}")

    def run(self) -> list[dict]:
        i, t = 0, self.tokens
        while i < len(t):
            word = t[i][0]
            if word in ("package", "import"):
                j = i
                while j < len(t) and t[j][0] != ";":
                    j += 1
                self.add(word, "".join(x for x, _ in t[i + 1 : j] if x != "static"), start=t[i][1], end=t[i][1])
                i = j + 1
            elif word in TYPES and i + 1 < len(t) and re.match(r"[A-Za-z_$]", t[i + 1][0]) and (i == 0 or t[i - 1][0] != "."):
                i = self.type_at(i, "")
            else:
                i += 1
        return self.rows

    def type_at(self, i: int, outer: str) -> int:
        t, kind, name, line = self.tokens, self.tokens[i][0], self.tokens[i + 1][0], self.tokens[i][1]
        j, parents, mode = i + 2, {"extends": [], "implements": []}, None
        while t[j][0] != "{":
            if t[j][0] in parents:
                mode = t[j][0]
            elif t[j][0] == "<":
                j = self.close_of(j, "<", ">")
            elif t[j][0] == "(":
                j = self.close_of(j, "(", ")")
            elif mode and re.match(r"[A-Za-z_$]", t[j][0]) and t[j - 1][0] != ".":
                parents[mode].append(t[j][0])
            j += 1
        end = self.close_of(j, "{", "}")
        up = parents["extends"][0] if kind == "class" and parents["extends"] else ""
        faces = parents["implements"] + (parents["extends"] if kind == "interface" else [])
        self.add("type", name, outer, kind, up, faces, line, t[end][1])
        k = j + 1
        if kind == "enum":
            while k < end and t[k][0] != ";":
                k += 1
        while k < end:
            k = self.member_at(k, end, name)
        return end + 1

    def member_at(self, i: int, end: int, owner: str) -> int:
        """One member of a type: a nested type, a method or a field."""
        t, j, mods, notes = self.tokens, i, [], []
        while j < end:
            if t[j][0] == "@" and t[j + 1][0] != "interface":
                notes.append(t[j + 1][0])
                j += 2
                if t[j][0] == "(":
                    j = self.close_of(j, "(", ")") + 1
            elif t[j][0] in MODIFIERS:
                mods.append(t[j][0])
                j += 1
            else:
                break
        if j >= end or t[j][0] == ";":
            return j + 1
        if t[j][0] in TYPES and t[j + 1][0] not in ("(", "=", ";", "."):
            return self.type_at(j, owner)
        if t[j][0] == "{":
            return self.close_of(j, "{", "}") + 1
        k, head = j, []
        while k < end and t[k][0] not in ("(", "=", ";", "{"):
            if t[k][0] == "<":
                c = self.close_of(k, "<", ">")
                head.append("<" + "".join(x for x, _ in t[k + 1 : c]) + ">")
                k = c + 1
            else:
                head.append(t[k][0])
                k += 1
        if k >= end or not head:
            return end
        if t[k][0] == "(":
            close = self.close_of(k, "(", ")")
            params = self.params(k + 1, close)
            b = close + 1
            while t[b][0] not in ("{", ";"):
                b += 1
            last = self.close_of(b, "{", "}") if t[b][0] == "{" else b
            returns = "".join(head[:-1])
            view = next((m for m in mods if m in ("public", "protected", "private")), "package")
            signature = f"{head[-1]}({','.join(p for p, _ in params)})"
            row = self.add("method", head[-1], owner, returns, view, [p for p, _ in params], t[j][1], t[last][1])
            self.add("modifiers", head[-1], owner, "", signature, sorted(set(mods)) + ["@" + n for n in notes], t[j][1], t[last][1])
            if t[b][0] == "{":
                self.body(b + 1, last, owner, row["name"], signature)
            return last + 1
        self.add("field", head[-1] if len(head) > 1 else "", owner, "".join(head[:-1]), "", [], t[j][1], t[j][1])
        while k < end and t[k][0] != ";":
            k = self.close_of(k, "{", "}") + 1 if t[k][0] == "{" else k + 1
        return k + 1

    def params(self, a: int, b: int) -> list[tuple[str, str]]:
        out, held, depth = [], [], 0
        for word, _ in [*self.tokens[a:b], (",", 0)]:
            depth += (word == "<") - (word == ">")
            if word == "," and not depth:
                held = [x for x in held if x != "final"]
                if len(held) > 1:
                    out.append(("".join(held[:-1]), held[-1]))
                held = []
            else:
                held.append(word)
        return out

    def body(self, a: int, b: int, owner: str, method: str, signature: str) -> None:
        t = self.tokens
        for k in range(a, b):
            word, line = t[k]
            after = t[k + 1][0] if k + 1 < b else ""
            before = t[k - 1][0]
            if word in FLOW and not (word == "while" and before == "}" and self._closes_do(k)):
                kind, cond = FLOW[word], ""
                if after == "(":
                    c = self.close_of(k + 1, "(", ")")
                    cond = " ".join(x for x, _ in t[k + 2 : c])
                    if kind == "FOR" and ":" in [x for x, _ in t[k + 2 : c]] and ";" not in cond:
                        kind = "FOR_EACH"
                cond = cond if len(cond) <= 60 else cond[:57] + "..."
                self.add("flow", kind, owner, method, cond, [signature], line, line)
            elif after == "(" and re.match(r"[A-Za-z_$]", word) and word not in NOT_CALLED and before != "new":
                scope = t[k - 2][0] if before == "." else ""
                self.add("call", word, owner, method, scope, [signature], line, line)
            elif after == "=" and re.match(r"[A-Za-z_$]", word):
                declared = re.match(r"[A-Za-z_$]", before) and before not in NOT_CALLED or before in (">", "]")
                if before == "." and t[k - 2][0] == "this":
                    self.add("access", word, owner, method, "write", [signature], line, line)
                else:
                    self.add("data", word, owner, method, "declaration" if declared else "assignment", [before if declared else ""], line, line)
            elif before == "." and t[k - 2][0] == "this" and after != "(":
                self.add("access", word, owner, method, "read", [signature], line, line)

    def _closes_do(self, k: int) -> bool:
        depth = 0
        for i in range(k - 1, -1, -1):
            depth += (self.tokens[i][0] == "}") - (self.tokens[i][0] == "{")
            if not depth:
                return i > 0 and self.tokens[i - 1][0] == "do"
        return False


def java_facts(text: str) -> list[dict]:
    return JavaFacts(text).run() if _FACTUAL.search(text) else []


#: CH3: providers by extension; the default is Java's.
PROVIDERS = {".java": java_facts}


def analyze(files: DataFrame, providers: dict | None = None) -> DataFrame:
    """CH2, CH3: ``files`` (``file_path``, ``content``) to fact rows, by the provider of each file's extension.

    A failure is a ``parse_error`` row, never an exception.
    """
    known = dict(providers or PROVIDERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.file_path, frame.content, strict=True):
                extension = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    found = known.get(extension, known.get(".java"))(content or "")
                except Exception as e:  # noqa: BLE001  any failure of a provider belongs to its file
                    found = [{"kind": "parse_error", "ord": 0, "name": type(e).__name__, "owner": "", "type": "", "detail": str(e), "names": [], "start_line": 0, "end_line": 0}]
                rows += [{"file_path": path, **r} for r in found]
            yield pd.DataFrame(rows, columns=["file_path", "kind", "ord", "name", "owner", "type", "detail", "names", "start_line", "end_line"])

    return files.select("file_path", "content").mapInPandas(run, FACTS)


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def most_specific_type(members: DataFrame, types: DataFrame) -> DataFrame:
    """JN5, JN7: each member (``file_path``, ``ord``, ``name``, lines) with the narrowest type of its file around it, the first on ties."""
    t = types.select("file_path", F.col("name").alias("type_name"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("ord").alias("type_ord"))
    pairs = members.join(t, "file_path", "left").where("s is null or (start_line >= s and end_line <= e)")
    keys = ["file_path", "ord", "name", "start_line", "end_line"]
    return pairs.groupBy(*keys).agg(F.min_by("type_name", F.struct(F.col("e") - F.col("s"), "type_ord")).alias("type_name"))


def indexes(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AGG13: class to path (the last in path order wins), interface to its implementations, class to parent."""
    types = of_kind(facts, "type")
    where = types.groupBy(F.col("name").alias("class_name")).agg(F.max("file_path").alias("path"))
    faces = types.select(F.explode("names").alias("interface"), "name").groupBy("interface").agg(F.sort_array(F.collect_set("name")).alias("implementations"))
    parent = types.where("detail != ''").groupBy(F.col("name").alias("class_name")).agg(F.max_by("detail", "file_path").alias("parent"))
    return where, faces, parent


def methods_of(facts: DataFrame) -> DataFrame:
    """AGG13: class to the names of its methods, in order of name."""
    return of_kind(facts, "method").groupBy(F.col("owner").alias("class_name")).agg(F.sort_array(F.collect_set("name")).alias("methods"))


def call_targets(facts: DataFrame) -> DataFrame:
    """JN8, JN9: the path of each call's target: by scope as a class, by the scope's field type, by scope with a usual suffix.

    Three left joins on small keys and the first that finds; calls without scope stay in their file.
    """
    where = indexes(facts)[0]
    calls = of_kind(facts, "call").select("file_path", "ord", F.col("owner").alias("caller_class"), F.col("type").alias("caller"), F.col("name").alias("callee"), F.col("detail").alias("scope"), F.col("start_line").alias("line"))
    by_name = where.select(F.col("class_name").alias("scope"), F.col("path").alias("p1"))
    fields = of_kind(facts, "field").select("file_path", F.col("owner").alias("caller_class"), F.col("name").alias("scope"), F.regexp_replace("type", "<.*>", "").alias("class_name")).dropDuplicates(["file_path", "caller_class", "scope"])
    by_field = fields.join(where, "class_name").select("file_path", "caller_class", "scope", F.col("path").alias("p2"))
    suffixes = where.select(F.regexp_replace("class_name", "(Service|Repository|Dao|Controller|Impl)$", "").alias("scope"), F.col("path").alias("p3"), "class_name")
    suffixes = suffixes.where("scope != class_name and scope != ''").groupBy("scope").agg(F.min("p3").alias("p3"))
    out = calls.join(by_name, "scope", "left").join(by_field, ["file_path", "caller_class", "scope"], "left").join(suffixes, "scope", "left")
    target = F.when(F.col("scope").isin("", "this"), F.col("file_path")).otherwise(F.coalesce("p1", "p2", "p3"))
    return out.select("file_path", "ord", "caller_class", "caller", "scope", "callee", "line", target.alias("target_path"))


def cross_file_calls(facts: DataFrame) -> DataFrame:
    """JN9."""
    return call_targets(facts).where("target_path is not null and target_path != file_path")


def callees_text(facts: DataFrame) -> DataFrame:
    """AGG14: the different callees of each caller, in order of their first call."""
    calls = of_kind(facts, "call")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    return calls.groupBy("file_path", "owner", F.col("type").alias("caller")).agg(F.array_join(F.array_distinct(ordered), ", ").alias("callees"))


# Each occurrence counts, in literals and comments too.
BRANCHES = ("if(", "if (", "for(", "for (", "while(", "while (", "case ", "catch(", "catch (", "&&", "||")


def complexity(body: Column) -> Column:
    """AGG19: 1 and an occurrence each of the words that branch."""
    return sum((count_of(body, b) for b in BRANCHES), F.lit(1))


def slices(files: DataFrame, facts: DataFrame) -> DataFrame:
    """CH1: chunks by method, by type and by file: (``chunk_id``, ``granularity``, ``file_path``, ``class_name``, ``method_name``, ``content``, lines)."""
    body = F.split("content", "\n")
    text = lambda s, e: F.array_join(F.slice(body, s, e - s + 1), "\n")
    methods = of_kind(facts, "method")
    typed = most_specific_type(methods.select("file_path", "ord", "name", "start_line", "end_line"), of_kind(facts, "type"))
    by_method = methods.join(typed.select("file_path", "ord", "type_name"), ["file_path", "ord"]).join(files, "file_path")
    ident = F.concat(F.lit("method:"), F.coalesce("type_name", "owner"), F.lit("."), "name", F.lit("("), F.array_join("names", ","), F.lit(")"))
    m = by_method.select(ident.alias("chunk_id"), F.lit("METHOD").alias("granularity"), "file_path", F.coalesce("type_name", "owner").alias("class_name"), F.col("name").alias("method_name"), text(F.col("start_line"), F.col("end_line")).alias("content"), "start_line", "end_line")
    c = of_kind(facts, "type").join(files, "file_path").select(F.concat("type", F.lit(":"), "name").alias("chunk_id"), F.lit("CLASS").alias("granularity"), "file_path", F.col("name").alias("class_name"), F.lit(None).cast("string").alias("method_name"), text(F.col("start_line"), F.col("end_line")).alias("content"), "start_line", "end_line")
    f = files.select(F.concat(F.lit("file:"), "file_path").alias("chunk_id"), F.lit("FILE").alias("granularity"), "file_path", F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("string").alias("method_name"), "content", F.lit(1).alias("start_line"), F.size(body).alias("end_line"))
    return m.unionByName(c).unionByName(f)


def searchable(chunks: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "class_name", "method_name", "content")
    return chunks.withColumn("text", text)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """JN10, JN11: of the candidates for each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
