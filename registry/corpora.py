"""Corpora derived from the given ``documents`` table, in Spark and as SQL for the check.

``line`` corpus: one sample line per file, 50 different ones, plus the document text.
``code`` corpus: JavaScript and TypeScript modules that import and call each other.
Both grow with ``documents``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


NBSP = " "

# Sample id, extension, sample line
SAMPLES = [
    (0, ".js", 'const dbPassword = "hunter2hunter2"'),
    (1, ".ts", "api-key = 'abcd1234efgh'"),
    (2, ".js", "child.execSync(cmd)"),
    (3, ".js", "spawn(cmd, { shell: true })"),
    (4, ".ts", "exec(`rm ${name}`)"),
    (5, ".jsx", "eval (body)"),
    (6, ".js", "node.innerHTML = html"),
    (7, ".tsx", "<p dangerouslySetInnerHTML={{ __html: h }} />"),
    (8, ".js", "document.write(markup)"),
    (9, ".js", 'document.write("ok")'),
    (10, ".js", 'document.write( "spaced")'),
    (11, ".ts", 'o["__proto__"] = p'),
    (12, ".py", "os.system(cmd)"),
    (13, ".py", "subprocess.run(cmd, shell=True)"),
    (14, ".py", "obj = pickle.loads(raw)"),
    (15, ".py", "cfg = yaml.load(fh)"),
    (16, ".py", "cfg = yaml.load(fh, Loader=yaml.SafeLoader)"),
    (17, ".py", "exec(code)"),
    (18, ".py", 'cur.execute(f"select {x}")'),
    (19, ".py", 'cur.execute("select %s" % x)'),
    (20, ".py", "return render_template_string(t)"),
    (21, ".py", "Environment(loader=l).from_string(t)"),
    (22, ".py", 'open(request.args["p"])'),
    (23, ".php", "shell_exec($c);"),
    (24, ".php", 'mysqli_query($c, "select $x");'),
    (25, ".php", "$db->query($_GET['q']);"),
    (26, ".php", "require_once($page);"),
    (27, ".php", "extract($_POST);"),
    (28, ".php", "unserialize($_COOKIE['s']);"),
    (29, ".php", "assert($expr);"),
    (30, ".c", "strcpy(dst, src);"),
    (31, ".c", "printf(fmt);"),
    (32, ".c", 'printf("ok %d", n);'),
    (33, ".cpp", "sprintf(buf, fmt);"),
    (34, ".c", "p = malloc(n * size);"),
    (35, ".h", "p = malloc(n * size);"),
    (36, ".hpp", "gets(buf);"),
    (37, ".java", "Runtime.getRuntime().exec(cmd);"),
    (38, ".java", "File f = new File(path);"),
    (39, ".java", 'File f = new File("a");'),
    (40, ".java", 'st.executeQuery("select " + id);'),
    (41, ".cs", "Process.Start(cmd);"),
    (42, ".cs", 'var c = new SqlCommand("x" + id);'),
    (43, ".cs", "File.ReadAllText(p);"),
    (44, ".py", "# os.system(cmd)"),
    (45, ".js", "eval(x) // scan-ignore"),
    (46, ".js", "étoken = 'abcdefgh1'"),
    (47, ".js", f"token{NBSP}= 'abcdefgh1'"),
    (48, ".js", "regex.exec(text)"),
    (49, ".py", "Environment(a)(b).from_string(t)"),
]
EXPECTED = {
    0: (), 1: (1,), 2: (2,), 3: (3,), 4: (4,), 5: (5,), 6: (6,), 7: (7,), 8: (8,), 9: (), 10: (8,), 11: (9,),
    12: (10,), 13: (11,), 14: (12,), 15: (13,), 16: (), 17: (14,), 18: (15,), 19: (15,), 20: (16,), 21: (16,),
    22: (17,), 23: (18,), 24: (19,), 25: (20,), 26: (21,), 27: (22,), 28: (23,), 29: (24,), 30: (25,), 31: (26,),
    32: (), 33: (25, 26), 34: (27,), 35: (), 36: (25,), 37: (28,), 38: (29,), 39: (), 40: (30,), 41: (28,), 42: (31,),
    43: (32,), 44: (), 45: (), 46: (1,), 47: (1,), 48: (2,), 49: (),
}
DIRECTORIES = ["src", "src/auth", "api/routes", "services/core", "data/repository", "ui/widgets", "lib",
               "node_modules/pkg", "Vendor/x", "src\\win"]

# Module templates: slot, path, text. A document's slot is its id modulo their number; {n} is the document, {m} the first of its run.
MODULES = [
    (0, "src/app{m}.ts", """import express, { Router as makeRouter } from 'express'
import * as path from "path"
import './polyfill{m}'
import type { User } from './models/user{m}'
import { helper{m}, other as renamed } from './util{m}'
import main from './util{m}'
const router = makeRouter()
const { verify, sign: signToken, opts = {} } = require('jsonwebtoken')
const fs = require("fs");
router.get('/items', listItems)
router.post('/items', requireAuth, createItem)
app.use(logger)
export function listItems(req, res) {
  helper{m}(req.query.q)
  main(path.join(req.body.dir, 'x'))
  return res.json(renamed(req))
}
async function createItem({ body }, [first], limit = 10, ...rest) {
  await fetch(`/api/svc{m}.py?x=1`)
  fetch("/healthz")
  return listItems(body)
}
export { createItem as create, listItems }
export default router
"""),
    (1, "src/util{m}.js", """export const helper{m} = async (value, opts = {}) => {
  return other(value)
}
export const other = function (x) {
  return x
};
const inc = n => n + 1
let twice = (f, ...args) => f(args)
export default function main{m}(a) {
  return inc(a)
}
function main{m}(a, b) {
  return twice(b)
}
"""),
    (2, "ui/Page{m}.jsx", """import React, { useState, useEffect } from 'react'
import Base from '../lib{m}'
import next from 'next/link'
export default class Page{m} extends React.Component {
  constructor(props) {
    super(props)
    this.load()
  }
  async load(id, { deep }) {
    await this.fetchAll(id)
    fetch('svc{m}.py#frag')
  }
  static of(items) {
    return items.map(wrap)
  }
}
class Other{m} extends Base {
  render() {
    return draw(new Canvas(1))
  }
}
"""),
    (3, "api/svc{m}.py", """import os
def run(cmd):
    os.system(request.args.get('cmd'))
"""),
    (4, "lib{m}/index.ts", """export * as tools from '../src/util{m}'
export default class Base {
  draw(canvas: Canvas, scale?: number) {
    return paint(canvas)
  }
}
export abstract class Shape<T> extends Base {
  area(): number {
    return 0
  }
}
"""),
    (5, "src/models/user{m}.ts", """const mongoose = require('mongoose')
import axios from 'axios'
export const schema = { name: 'x' }
const store = {
  save(user) {
    return axios.post('/u', user)
  },
  load(id) {
    return mongoose.find(id)
  }
}
export default async () => {
  return store.save(schema)
}
"""),
    (6, "src/pages/page{m}.js", """import { helper{m} as h } from '../util{m}.js'
import * as util from '/src/util{m}'
import { missing } from './nowhere'
function handler(req, res) {
  if (req) {
    h(util(req))
  }
  missing(handler)
}
export default handler;
"""),
    (7, "src\\win{m}.ts", """import { helper{m} } from './src/util{m}'
fetch('util{m}.js')
const run = function named(cmd, cb = () => 1) {
  helper{m}(cmd); eval(cmd)
}
"""),
    (8, "vendor/lib{m}.js", """export function ignored() {
  return 1
}
"""),
    (9, "tools/cli{m}.mjs", """import { helper{m} } from '../src/util{m}'
helper{m}()
"""),
    (10, "src/loginFlow{m}.tsx", """import sequelize from "sequelize"
import {
  hash as digest, // the stored form
  compare
} from 'bcrypt'
import reactExpress from 'react-express'
/* phantom(1) is no call
 * nor is ghost(2)
 */
export async function signup(
  user: User,
  password = salt(rounds(10, { deep: [1, 2] }))
): Promise<void> {
  const keep = (row) => {
    return save(row)
  }
  const text = `for ${label(user)} not(this)
    nor(that)`
  return keep(digest(password), text)
}
function save(row) { return sequelize.insert(row) }
const {
  readFile,
  writeFile: put
} = require('fs')
export {
  save,
  signup as enter
}
"""),
    (11, "src/loop{m}.js", """import { ping } from './loop{m}'
export function ping(x) {
  return pong(x)
}
export function pong(x) {
  return ping(x)
}
app.delete(removeAll)
"""),
    (12, "worked/bundle{m}.js", """import { helper{m} as help } from './util{m}'; const a = 1; function after(x) { one(x); function inner() { two() } inner() } export const q = 1, r = () => three(), s = function (y) { return four(y) };
class Box extends Base { constructor(a = make(deep(1))) { super(a); this.fill(a) } async *each({ b, c: { d } }, [e], ...f) { yield g(h(i(j(b)))) } static of(cb = () => { cbInner() }) { return new Box(cb()) } }
const { u: { v: { w } }, z: k } = require('deep'), other = require("./other{m}");
app.get('/x', (req, res) => { send(req); later() }); fetch('/api/svc{m}.py'); export { after as later, Box };
"""),
    (13, "worked/deep{m}.ts", """import base,
  * as all
  from "./base{m}"
export const first = 1,
  second = (
    a: number,
    cb: (e: Error) => void = () => { quiet() },
  ): Promise<Map<string, number>> => {
    return call(cb(nest(a)))
  },
  third = wait
@Service({ scope: pick(1) })
export class Tower<T extends Map<string, T>>
  extends mix(Base, Other)
{
  constructor(
    @Inject(TOKEN) items: T[],
    { size = 1, at: [x, y] }: Shape = shape(),
    ...rest: string[]
  ) {
    super()
    const add = async (n, { deep: { deeper } } = {}) =>
      lift(n)
        .then(store)
    add(text(`a ${pick(`b ${inner(1)}`)} c`))
  }
  get height(): { value: number } {
    if (/["'({]/.test(this.name)) { return tall({ value: low() }) }
    return first
  }
}
export default async function(
  req,
  res = reply(
    { ok: true }
  ),
) {
  res.send(all(req)); function late() { tidy() } late()
}
"""),
]
#: Rows of the files under worked/, found by reading them: the slot, the line, and the statement's place on it.
WORKED = {
    # kind, source, alias, type, specifiers, (imported, local) pairs
    "imports": [
        (12, 1, 0, "import", "./util{m}", "help", "named", ["helper{m}"], [("helper{m}", "help")]),
        (12, 3, 0, "require", "deep", None, "require", ["u", "z"], [("z", "k")]),
        (12, 3, 1, "require", "./other{m}", "other", "require", ["other"], [("default", "other")]),
        (13, 1, 0, "import", "./base{m}", "all", "namespace", ["base", "*"], [("default", "base"), ("*", "all")]),
    ],
    # name, type, alias, the readings that list it
    "exports": [
        (12, 1, 8, "q", "named", None, ["detail"]), (12, 1, 9, "r", "named", None, ["detail"]), (12, 1, 10, "s", "named", None, ["detail"]),
        (12, 4, 5, "later", "named", "after", ["summary", "detail"]), (12, 4, 6, "Box", "named", "Box", ["summary", "detail"]),
        (13, 4, 0, "first", "named", None, ["detail"]), (13, 5, 0, "second", "named", None, ["detail"]), (13, 11, 0, "third", "named", None, ["detail"]),
        (13, 13, 0, "Tower", "named", None, ["summary", "detail"]), (13, 32, 0, "default", "default", None, ["summary"]),
    ],
    # name, parameters, exported in the detail reading, async, arrow, type by reading
    "functions": [
        (12, 1, 2, "after", ["x"], False, False, False, ("function", "function")), (12, 1, 4, "inner", [], False, False, False, ("function", "function")),
        (12, 1, 9, "r", [], True, False, True, ("arrow", "arrow")), (12, 1, 10, "s", ["y"], True, False, False, ("function", "arrow")),
        (12, 2, 1, "Box.constructor", ["a"], False, False, False, ("method", "method")),
        (12, 2, 4, "Box.each", ["{...}", "[...]", "...f"], False, True, False, ("method", "method")),
        (12, 2, 7, "Box.of", ["cb"], False, False, False, ("method", "method")),
        (13, 5, 0, "second", ["a", "cb"], True, False, True, ("arrow", "arrow")),
        (13, 16, 0, "Tower.constructor", ["items", "...rest"], False, False, False, ("method", "method")),
        (13, 22, 0, "add", ["n"], False, True, True, ("arrow", "arrow")), (13, 27, 0, "Tower.height", [], False, False, False, ("method", "method")),
        (13, 38, 1, "late", [], False, False, False, ("function", "function")),
    ],
    # name, superclass, exported, methods
    "classes": [(12, 2, 0, "Box", "Base", False, ["constructor", "each", "of"]), (13, 13, 0, "Tower", None, True, ["constructor", "height"])],
    # caller, names called in one statement, the path of a request
    "calls": [
        (12, 1, 3, "after", ["one"], ""), (12, 1, 5, "inner", ["two"], ""), (12, 1, 7, "after", ["inner"], ""), (12, 1, 9, "r", ["three"], ""),
        (12, 1, 11, "s", ["four"], ""), (12, 2, 1, "Box.constructor", ["make", "deep"], ""), (12, 2, 2, "Box.constructor", ["fill"], ""),
        (12, 2, 5, "Box.each", ["g", "h", "i", "j"], ""), (12, 2, 7, "Box.of", ["cbInner"], ""), (12, 2, 8, "Box.of", ["cb"], ""),
        (12, 3, 0, "root", ["require"], ""), (12, 4, 0, "root", ["get"], ""), (12, 4, 1, "root", ["send", "later"], ""),
        (12, 4, 2, "root", ["fetch"], "/api/svc{m}.py"),
        (13, 5, 0, "second", ["quiet"], ""), (13, 9, 0, "second", ["call", "cb", "nest"], ""), (13, 12, 0, "root", ["Service", "pick"], ""),
        (13, 13, 0, "root", ["mix"], ""), (13, 16, 0, "Tower.constructor", ["Inject", "shape"], ""), (13, 22, 0, "add", ["lift", "then"], ""),
        (13, 25, 0, "Tower.constructor", ["add", "text", "pick", "inner"], ""), (13, 28, 0, "Tower.height", ["test", "tall", "low"], ""),
        (13, 32, 0, "root", ["reply"], ""), (13, 38, 0, "root", ["send", "all"], ""), (13, 38, 2, "late", ["tidy"], ""), (13, 38, 4, "root", ["late"], ""),
    ],
    # method, handler
    "routes": [(12, 4, 0, "get", None)],
}
SLOTS = len(MODULES)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table has one row group, which one task would read; it is dealt to as many as the session's joins have."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id")


def line_corpus_from(documents: DataFrame) -> DataFrame:
    """(repo, file, content, seq); the 50-row sample table is broadcast."""
    spark = documents.sparkSession
    samples = spark.createDataFrame(pa.table({
        "sid": pa.array([s[0] for s in SAMPLES], pa.int64()), "ext": [s[1] for s in SAMPLES], "sample": [s[2] for s in SAMPLES]}))
    d, sid, blk = F.col("doc_id"), F.col("sid"), F.col("blk")
    numbered = (documents.select("doc_id", "text").withColumn("sid", F.pmod(d, F.lit(50)))
                .withColumn("blk", F.floor(d / 50).cast("bigint")))
    joined = numbered.join(F.broadcast(samples), "sid")
    folder = F.element_at(F.array(*[F.lit(x) for x in DIRECTORIES]), (F.pmod(blk, F.lit(10)) + 1).cast("int"))
    is_js = F.col("ext").isin(".js", ".jsx", ".ts", ".tsx")
    target = F.when(sid < 11, d + 1).when((sid == 11) & (blk % 2 == 0), d - 11).cast("string")
    imported = F.when(target.isNotNull(), F.concat(F.lit("import { fn"), target, F.lit(" } from './f"), target, F.lit("'"))).otherwise(
        F.lit("import React from 'react'"))
    returned = F.when(target.isNotNull(), F.concat(F.lit("  return fn"), target, F.lit("(a)"))).otherwise(F.lit("  return render(a)"))
    page = (blk * 50 + 23 + sid % 7).cast("string")
    head = F.when(is_js, F.concat(
        imported, F.lit("\nexport async function fn"), d.cast("string"), F.lit("(a, b) {\n"), returned,
        F.lit("\n}\nfetch('/f"), page, F.lit(".php')\n"))).otherwise(F.lit("x = 1\n"))
    return joined.select(
        F.concat(F.lit("repo"), (blk % 7).cast("string")).alias("repo"),
        F.concat(folder, F.lit("/f"), d.cast("string"), F.col("ext")).alias("file"),
        F.concat(head, F.col("sample"), F.lit("\r\n"), F.col("text"), F.lit("\n")).alias("content"), d.alias("seq"))


def line_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_corpus_from(_documents(spark, sf_dir))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(pa.table({
        "slot": pa.array([t[0] for t in MODULES], pa.int64()), "path": [t[1] for t in MODULES], "body": [t[2] for t in MODULES]}))
    d = F.col("doc_id")
    docs = (_documents(spark, sf_dir).select("doc_id", "text").withColumn("slot", F.pmod(d, F.lit(SLOTS)))
            .withColumn("m", (d - F.pmod(d, F.lit(SLOTS))).cast("string")))
    fill = lambda c: F.replace(F.replace(c, F.lit("{m}"), F.col("m")), F.lit("{n}"), d.cast("string"))
    return docs.join(F.broadcast(templates), "slot").select(
        F.concat(F.lit("repo"), (F.floor(d / 60) % 5).cast("string")).alias("repo"), fill(F.col("path")).alias("file"),
        F.concat(fill(F.col("body")), F.when(F.col("path").startswith("worked/"), "").otherwise(F.concat(F.col("text"), F.lit("\n")))).alias("content"),
        d.alias("seq"))


# --- the same corpora for the SQL check -------------------------------------

def q(text: str) -> str:
    """SQL string literal; line breaks are spelled with chr()."""
    quoted = "'" + text.replace("'", "''") + "'"
    return quoted.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")


def line_corpus_sql() -> str:
    samples = ", ".join(f"({s}, {q(e)}, {q(t)})" for s, e, t in SAMPLES)
    folders = "[" + ", ".join(q(x) for x in DIRECTORIES) + "]"
    return f"""
samples(sid, ext, sample) AS (VALUES {samples}),
numbered AS (SELECT doc_id, text, doc_id % 50 AS sid, doc_id // 50 AS blk FROM documents),
drafts AS (SELECT n.*, s.ext, s.sample, s.ext IN ('.js', '.jsx', '.ts', '.tsx') AS is_js,
  CASE WHEN n.sid < 11 THEN n.doc_id + 1 WHEN n.sid = 11 AND n.blk % 2 = 0 THEN n.doc_id - 11 END AS t
  FROM numbered n JOIN samples s USING (sid)),
corpus AS MATERIALIZED (SELECT 'repo' || (blk % 7) AS repo,
  {folders}[(blk % 10) + 1] || '/f' || doc_id || ext AS file,
  CASE WHEN is_js THEN
    CASE WHEN t IS NOT NULL THEN 'import {{ fn' || t || ' }} from ''./f' || t || '''' ELSE 'import React from ''react''' END
    || chr(10) || 'export async function fn' || doc_id || '(a, b) {{' || chr(10)
    || CASE WHEN t IS NOT NULL THEN '  return fn' || t || '(a)' ELSE '  return render(a)' END
    || chr(10) || '}}' || chr(10) || 'fetch(''/f' || (blk * 50 + 23 + sid % 7) || '.php'')' || chr(10)
  ELSE 'x = 1' || chr(10) END || sample || chr(13) || chr(10) || text || chr(10) AS content,
  doc_id AS seq FROM drafts)"""


def code_corpus_sql() -> str:
    rows = ", ".join(f"({s}, {q(p)}, {q(b)})" for s, p, b in MODULES)
    return f"""
templates(slot, path, body) AS (VALUES {rows}),
corpus AS MATERIALIZED (SELECT 'repo' || ((doc_id // 60) % 5) AS repo,
  replace(replace(path, '{{m}}', CAST(doc_id - doc_id % {SLOTS} AS VARCHAR)), '{{n}}', CAST(doc_id AS VARCHAR)) AS file,
  replace(replace(body, '{{m}}', CAST(doc_id - doc_id % {SLOTS} AS VARCHAR)), '{{n}}', CAST(doc_id AS VARCHAR))
    || CASE WHEN starts_with(path, 'worked/') THEN '' ELSE text || chr(10) END AS content,
  doc_id AS seq FROM documents JOIN templates ON slot = doc_id % {SLOTS})"""
