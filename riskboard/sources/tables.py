"""The benchmark tables read as the board's native tables.

Links between the tables are synthetic but deterministic; every mapping is a
projection or a map-side aggregate, so it costs no more than the scan itself.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.scale import widen
from ..functions.text import domain_of, host_of, nth, site_label

# event type of the benchmark → task status
STATUS_OF_EVENT = {
    "view": "PENDING", "click": "RUNNING", "purchase": "OK", "error": "FAILED",
    "signup": "RETRY_WAIT",
}
# users with a number divisible by this have run to the end: failures became terminal
ENDED = 3
# the company that owns a tenth of all documents, pages and labels; its run has ended
HOT_COMPANY = 6
# event type of the benchmark → review decision (views are no review)
DECISION_OF_EVENT = {
    "purchase": "采纳", "click": "修改", "error": "标记误报", "signup": "转人工",
}
# stand-in words: the benchmark texts hold none of the domain's own wording
STAND_IN_DICTIONARY = [
    ("idiot", "insult"), ("clown", "insult"), ("stupid", "insult"),
    ("token =", "secret"), ("@mail", "contact"), ("licensed", "licence"),
    ("license", "licence"), ("free", "promise"), ("ingereth", "promise"),
]
STAND_IN_WORDING = {
    "return_promise": ["free", "onlyyou"],
    "trade_advice": ["stupid", "idiot"],
    "price_forecast": ["clown"],
}

# fixed values: public-suffix rules that show each kind of rule
SUFFIX_RULES = [
    "com", "net", "org", "io", "sg", "com.sg", "id", "co.id", "br", "com.br", "github.io", "jp", "kyoto.jp", "*.kobe.jp",
    "!city.kobe.jp", "*.ck", "!www.ck", "xn--55qx5d.cn", "cn", "com.cn", "example.com", "example.org", "example.net",
]
# hosts that companies are given beside the crawled ones, by their number
HOST_ENDS = [
    "com.sg", "co.id", "github.io", "kyoto.jp", "a.kobe.jp", "city.kobe.jp", "b.ck", "www.ck", "xn--55qx5d.cn", "com.br", "unlisted",
]


class Tables:
    """Lazy reader of one folder of benchmark tables; each table is opened once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._open: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]

    def texts(self, name: str, key: str) -> DataFrame:
        """A table whose long texts are about to be worked on row by row."""
        return widen(self.read(name), key)

    @cached_property
    def companies(self) -> int:
        """How many companies there are. The count reads file footers only."""
        return max(1, self.read("customer").count())

    @property
    def busy(self) -> int:
        """How many companies own the rows with odd numbers."""
        return self.companies // 20 + 1

    def owner(self, key: str) -> Column:
        """The company a row belongs to: a tenth of all rows belongs to one company, the
        other odd numbers to a twentieth of the companies, the even ones to all that are
        squares by the number of companies. So some companies own many rows, most few or none."""
        d = F.col(key)
        return (F.when(F.pmod(d, F.lit(10)) == 7, F.lit(HOT_COMPANY % self.companies).cast("bigint"))
                .when(F.pmod(d, F.lit(2)) == 0, F.pmod(F.pmod(d, F.lit(self.companies)) * F.pmod(d, F.lit(self.companies)), F.lit(self.companies)))
                .otherwise(F.pmod(d, F.lit(self.busy))))


def company(t: Tables) -> DataFrame:
    """Complete company rows; ``risk`` is three-way: true, false, null."""
    bal = F.col("c_acctbal")
    return t.read("customer").select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("status"),
        F.when(bal < 0, True).when(bal >= 1000, False).alias("risk"),
        F.when(bal < 0, F.lower("c_mktsegment")).alias("risk_words"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.com"))
        .alias("active_domains"),
        F.when(F.col("c_nationkey") % 5 == 0, fixed.MODE_FALLBACK)
        .otherwise(fixed.MODE_MODEL).alias("analysis_mode"),
        F.col("c_nationkey").alias("nation_id"))


def _code(col: str, table: dict[str, str]) -> Column:
    pairs = [x for kv in table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.try_element_at(F.create_map(*pairs), F.col(col))


def shape_task_events(events: DataFrame) -> DataFrame:
    """Task events from event rows, batch or stream: three tasks in each phase."""
    k = F.get_json_object("props", "$.k").cast("int")
    idx = F.pmod(k, F.lit(12))
    folder = F.concat(nth(fixed.PHASES, idx), F.lit("/task_"), F.pmod(F.floor(k / 12), F.lit(3)).cast("string"))
    ended = F.when(F.col("event_type") == "error", "TERMINAL").otherwise("OK")
    status = F.when(F.col("user_id") % ENDED == 0, ended).otherwise(_code("event_type", STATUS_OF_EVENT))
    errors = list(fixed.LABELS["error"])
    code = nth(errors, F.pmod(F.floor("value"), F.lit(len(errors))))
    return events.select(
        "event_id", "ts", F.col("user_id").alias("company_id"), idx.alias("phase_idx"),
        nth(fixed.PHASES, idx).alias("phase"), folder.alias("task_dir"), status.alias("status"),
        F.when(status.isin("FAILED", "RETRY_WAIT"), code).alias("error_code"),
        F.sha2("props", 256).alias("input_sha"), k.alias("k"), "event_type", "value")


def task_event(t: Tables) -> DataFrame:
    return shape_task_events(t.read("events"))


def shape_review_events(events: DataFrame) -> DataFrame:
    decision = _code("event_type", DECISION_OF_EVENT)
    note = F.when(decision == "修改", F.get_json_object("props", "$.k")).otherwise("")
    return events.filter(F.col("event_type") != "view").select(
        "event_id", F.col("user_id").alias("company_id"),
        F.lit(fixed.REVIEWED).alias("status"),
        F.concat(F.lit("r"), F.pmod("event_id", F.lit(7)).cast("string")).alias("reviewer"),
        decision.alias("decision"), note.alias("note"), F.col("ts").alias("reviewed_at"))


def review_event(t: Tables) -> DataFrame:
    return shape_review_events(t.read("events"))


def source(t: Tables) -> DataFrame:
    """Source dimension; the type follows the number in the name."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    return t.read("documents").select("source").distinct().select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("Source "), F.col("source")).alias("name"),
        nth(fixed.SOURCE_TYPES, F.pmod(number, F.lit(4))).alias("type"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/")).alias("url"))


def evidence(t: Tables) -> DataFrame:
    """Evidence from documents; unused columns are pruned from the scan."""
    return _evidence(t, t.read("documents"))


def evidence_text(t: Tables) -> DataFrame:
    """The same, for work on the whole texts."""
    return _evidence(t, t.texts("documents", "doc_id"))


def _evidence(t: Tables, documents: DataFrame) -> DataFrame:
    return documents.select(
        t.owner("doc_id").alias("company_id"), F.col("doc_id").alias("evidence_id"),
        F.col("source").alias("source_id"), F.col("text").alias("content"),
        F.col("lang").alias("scope"), "n_chars",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/d/"),
                 F.col("doc_id").cast("string")).alias("origin_url"))


def claim(t: Tables) -> DataFrame:
    """Claims with their polarity: labelled documents, keyed by source and language."""
    polarity = t.read("labels").select(F.col("doc_id").alias("evidence_id"),
                                       (F.col("toxic") == 1).alias("supports"))
    key = F.concat_ws("/", "source_id", "scope").alias("claim_key")
    return (evidence(t).select("company_id", "evidence_id", key).join(polarity, "evidence_id"))


def inference(t: Tables) -> DataFrame:
    """Inferences with three basis ids each: the second is the same company's for odd ids,
    the third is mostly another's; high ids point at no evidence."""
    d = F.col("doc_id")
    return t.read("labels").select(
        t.owner("doc_id").alias("company_id"), d.alias("inference_id"),
        F.array(d, d + 10 * t.busy, d * 3).alias("basis"),
        F.when(F.col("quality") == 1, "中").otherwise("低").alias("confidence"))


def label(t: Tables) -> DataFrame:
    return t.read("labels").select(
        F.col("doc_id").alias("evidence_id"), t.owner("doc_id").alias("company_id"),
        (F.col("toxic") == 1).alias("risky"),
        (F.col("quality") == 1).alias("accepted"))


def page(t: Tables) -> DataFrame:
    host = host_of(F.col("url"))
    return t.read("pages").select(
        "page_id", t.owner("page_id").alias("company_id"), "url", "html", host.alias("host"))


def page_host(t: Tables) -> DataFrame:
    """Page keys and addresses, without the markup."""
    return page(t).select("page_id", "company_id", "url", "host",
                          domain_of(F.col("host")).alias("domain"),
                          site_label(F.col("host")).alias("site"))


def carrier(t: Tables) -> DataFrame:
    """Registered carriers: one per company and host; ``m.`` hosts are mini programs, a
    page without a usable address is none."""
    kind = F.when(F.startswith("host", F.lit("m.")), "mapp").otherwise("web")
    return (page_host(t).filter("host <> ''")
            .groupBy("company_id", kind.alias("kind"), F.col("host").alias("domain"))
            .agg(F.min("page_id").alias("pos"), F.first("site").alias("name")))


def registry(t: Tables) -> DataFrame:
    """Carriers as a registry reports them: by a loosely written company name."""
    reg = F.format_string("customer  #%09d ", F.col("company_id"))
    return carrier(t).select(reg.alias("registered_name"), "kind", "domain")


def site_candidate(t: Tables) -> DataFrame:
    """Candidate hosts: each registered domain, bare and with ``www.``."""
    both = F.explode(F.array(F.col("domain"), F.concat(F.lit("www."), F.col("domain"))))
    return page_host(t).select("domain").distinct().select(both.alias("domain"))


def account(t: Tables) -> DataFrame:
    """Social accounts: one per company, platform (host prefix) and site name."""
    platform = F.when(F.col("host").rlike(r"^(www|blog|m)\."),
                      F.substring_index("host", ".", 1)).otherwise("direct")
    certified = F.max(F.startswith("url", F.lit("https:")))
    return (page_host(t).groupBy("company_id", platform.alias("platform"), F.col("site").alias("name"))
            .agg(F.count(F.lit(1)).alias("score"),
                 F.when(certified, "企业认证").otherwise(fixed.UNCERTIFIED).alias("official_status")))


def post(t: Tables) -> DataFrame:
    return t.read("conversations")


def process_file(t: Tables) -> DataFrame:
    """Process files from documents: kind by language, measured size and hash."""
    kinds = {"en": "过程文本", "fr": "截图", "de": "final.json", "es": "result.json"}
    return t.read("documents").select(
        t.owner("doc_id").alias("company_id"),
        F.coalesce(_code("lang", kinds), F.lit(fixed.OTHER)).alias("kind"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def manifest(t: Tables) -> DataFrame:
    """A recorded file list: two entries per label, sizes in characters, so entries
    of non-ASCII files differ from the measured size and high ids are missing."""
    ids = t.read("labels").select(F.explode(F.array(F.col("doc_id"), F.col("doc_id") * 3))
                                  .alias("doc_id")).distinct()
    docs = t.read("documents").select("doc_id", "source", F.col("n_chars").alias("bytes"),
                                      F.sha2("text", 256).alias("sha256"))
    return ids.join(docs, "doc_id", "left").select(
        F.concat_ws("/", F.coalesce("source", F.lit("gone")), F.col("doc_id").cast("string"))
        .alias("path"), "bytes", "sha256")


def dictionary(t: Tables) -> DataFrame:
    """A long dictionary ``keyword, category``: names of companies and products, phrases of
    three words, and the stand-in words."""
    words = F.split(F.lower("text"), r"[ \t\n\f\r]+")
    phrases = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))
    listed = t.spark.createDataFrame(STAND_IN_DICTIONARY, "keyword string, category string")
    return (t.read("benchmark").select(F.explode(phrases).alias("keyword"), F.lit("phrase").alias("category"))
            .unionByName(t.read("part").select(F.col("p_name").alias("keyword"), F.lit("product").alias("category")))
            .unionByName(t.read("customer").select(F.col("c_name").alias("keyword"), F.lit("company").alias("category")))
            .unionByName(t.read("documents").select(F.col("lang").alias("keyword"), F.lit("language").alias("category")).distinct())
            .unionByName(listed).distinct())


def verdict_event(t: Tables) -> DataFrame:
    """How the verdict of a company changed: each step of its risk analysis tells anew,
    without a verdict while the phase is not done."""
    done = F.when(F.col("status") == "OK", F.col("value") >= 50)
    return task_event(t).filter("phase = 'RISK_ANALYSIS'").select("company_id", "ts", "event_id", done.alias("risk"), "status")


def suffix_rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")


def named_host(t: Tables) -> DataFrame:
    """Hosts of companies: those of their pages, and one under a suffix of each kind; every
    twelfth company is known by an address only."""
    key, kinds = F.col("c_custkey"), len(HOST_ENDS) + 1
    at = F.pmod(key, F.lit(kinds)).cast("int")
    site = F.concat(F.when(key % 2 == 0, "Shop.").otherwise(""), F.lit("c"), F.floor(key / 24).cast("string"))
    given = F.when(at == kinds - 1, F.concat(F.lit("10.0."), F.pmod(F.floor(key / 256), F.lit(256)).cast("string"), F.lit("."),
                                             F.pmod(key, F.lit(256)).cast("string"))).otherwise(F.concat(site, F.lit("."), nth(HOST_ENDS, at)))
    return (t.read("customer").select(key.alias("company_id"), given.alias("host"))
            .unionByName(page_host(t).filter("host <> ''").select("company_id", "host")))


def supply_link(t: Tables) -> DataFrame:
    """Links from companies to the products they ordered, to who supplied these, and on to
    nations and regions: ``source, target``."""
    def name(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    lines = t.read("lineitem")
    bought = lines.join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        name("company", "o_custkey").alias("source"), name("product", "l_partkey").alias("target"))
    links = [bought, lines.select(name("product", "l_partkey").alias("source"), name("supplier", "l_suppkey").alias("target")),
             t.read("supplier").select(name("supplier", "s_suppkey").alias("source"), name("nation", "s_nationkey").alias("target")),
             t.read("nation").select(name("nation", "n_nationkey").alias("source"), name("region", "n_regionkey").alias("target"))]
    return links[0].unionByName(links[1]).unionByName(links[2]).unionByName(links[3])
