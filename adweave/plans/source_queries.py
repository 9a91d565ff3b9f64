"""Queries that normalise payloads which Spark makes of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from adweave.plans.adapters import by_key, by_key_sql, table, utc
from adweave.sources.html import fact, html_to_text, job_posting
from adweave.sources.lists import euraxess_list, euro_salary, jobsacuk_list, jobsireland_list, types_from_hours
from adweave.sources.normalise import NORMALISERS, admitted, merge_details, prune_sources, read_wanted, sitemap_changed_since, union_sources

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def base(spark, d):
    """orders with their customers: what an employer's system would hold."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("k"), F.concat(F.lit("Job "), F.col("o_orderpriority")).alias("title"), F.col("c_name").alias("company"), F.concat(F.lit("Town "), (k % 50).cast("string")).alias("town"), F.floor("o_totalprice").alias("low"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), utc("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("https://jobs.example.org/"), k.cast("string")).alias("url"),
    )


BASE = """base AS (SELECT o_orderkey AS k, 'Job ' || o_orderpriority AS title, c_name AS company, 'Town ' || CAST(o_orderkey % 50 AS VARCHAR) AS town, CAST(floor(o_totalprice) AS BIGINT) AS low,
  strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate AS dt, o_orderstatus AS status, 'https://jobs.example.org/' || CAST(o_orderkey AS VARCHAR) AS url FROM orders JOIN customer ON c_custkey = o_custkey)"""
MONEY = "format('{:,}', low)"
NOON = "CAST(epoch(date_trunc('day', dt)) AS BIGINT) + 43200"
SHOWN = ("source_job_id", "title", "company", "location_text", "country", "posted", "date_precision", "types", "work_mode", "salary_text")


def shown(name, payloads):
    rows = NORMALISERS[name](payloads)
    return rows.withColumn("posted", F.unix_seconds("posted_at")).withColumn("types", F.array_join("job_types", ",")).select(*SHOWN)


def expected(job_id="CAST(k AS VARCHAR)", title="title", company="company", place="town", country="NULL", posted=NOON, precision="'day'", types="NULL", mode="NULL", salary="NULL", where="true"):
    text = lambda x: f"CAST({x} AS VARCHAR)"
    return f"WITH {BASE} SELECT {text(job_id)} AS source_job_id, {text(title)} AS title, {text(company)} AS company, {text(place)} AS location_text, {text(country)} AS country, CAST({posted} AS BIGINT) AS posted, {precision} AS date_precision, {text(types)} AS types, {text(mode)} AS work_mode, {text(salary)} AS salary_text FROM base WHERE {where}"


def add(name, source, payload, sql):
    def run(spark, d):
        return shown(source, base(spark, d).select(payload().alias("payload")))

    QUERIES[name] = (run, sql)


def doc(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "true"})


def st(**fields):
    return F.struct(*(v.alias(k) for k, v in fields.items()))


psql = lambda *v: by_key_sql("k", list(v))
some = lambda c: F.nullif(c, F.lit(""))


def pick(*values):
    return by_key(F.col("k"), list(values))

add(
    "a1_adzuna", "adzuna",
    lambda: doc(id=F.col("k").cast("string"), title=F.concat(F.lit("<b>"), "title", F.lit("</b>")), company=st(display_name=F.col("company")), location=st(display_name=F.col("town")), country=pick("GB", "DE"), created=F.concat("day", F.lit("T08:30:00Z")), description=F.lit("<p>Do this.</p><ul><li>And that</li></ul>"), contract_type=some(pick("permanent", "contract", "")), contract_time=some(pick("full_time", "part_time", "full_time", "")), salary_min=F.col("low").cast("double"), salary_max=(F.col("low") + 1000).cast("double"), salary_is_predicted=pick("0", "1", "0")),
    expected(country=psql("GB", "DE"), posted="epoch(date_trunc('day', dt)) + 30600", precision="'exact'", types="CASE WHEN k % 4 = 1 THEN CASE k % 3 WHEN 1 THEN 'part_time,freelance_or_contract,fixed_term' ELSE 'part_time' END WHEN k % 3 = 0 THEN 'full_time_permanent' WHEN k % 3 = 1 THEN 'freelance_or_contract,fixed_term' WHEN k % 4 IN (0, 2) THEN 'full_time_permanent,fixed_term' END",
             salary=f"CASE WHEN k % 3 <> 1 THEN {psql('GBP', 'EUR')} || ' ' || {MONEY} || '-' || format('{{:,}}', low + 1000) END"),
)
add("a2_arbeitnow", "arbeitnow", lambda: doc(slug=F.col("k").cast("string"), title=F.col("title"), company_name=F.col("company"), location=F.col("town"), created_at=F.unix_seconds("at"), description=F.lit("<p>Do this.</p><ul><li>And that</li></ul>"), job_types=F.array(pick("Full time permanent", "Part time", "berufserfahren")), remote=F.col("status") == "O"),
    expected(posted="epoch(dt)", precision="'exact'", types=psql("full_time_permanent", "part_time", ""), mode="CASE WHEN status = 'O' THEN 'remote' END"))
add("a3_jobtech", "jobtech", lambda: doc(id=F.col("k").cast("string"), headline=F.col("title"), publication_date=F.concat("day", F.lit("T12:00:00")), removed=F.col("status") == "P", employer=st(name=F.col("company")), workplace_address=st(city=F.upper("town"), municipality=F.col("town"), region=F.lit("Skåne"), country=pick("Sverige", "Norge", "Sverige")), working_hours_type=st(label=pick("Heltid", "Deltid")), duration=st(label=pick("Tillsvidare", "6 månader"))),
    expected(place="town || ', Skåne'", country="'SE'", posted="epoch(timezone('Europe/Stockholm', date_trunc('day', dt) + INTERVAL 12 HOUR))", precision="'exact'", types=psql("full_time_permanent", "part_time,fixed_term"), where="status <> 'P' AND k % 3 <> 1"))
add("a4_bundesagentur", "bundesagentur", lambda: doc(referenznummer=F.col("k").cast("string"), stellenangebotsTitel=F.col("title"), firma=F.col("company"), stellenlokationen=F.array(st(adresse=st(ort=F.col("town"), region=F.lit("SACHSEN"), land=F.lit("Deutschland"))), st(adresse=st(ort=F.col("town"), region=F.lit("SACHSEN"), land=F.lit("Deutschland")))), datumErsteVeroeffentlichung=F.col("day"), gehaltsspanneVon=F.col("low").cast("double"), stellenangebotsart=pick("ARBEIT", "AUSBILDUNG"), arbeitszeitVollzeit=F.col("k") % 3 > 0, vertragsdauer=F.lit("UNBEFRISTET")),
    expected(country="'DE'", types="concat_ws(',', CASE WHEN k % 2 = 1 THEN 'internship_or_working_student' END, CASE WHEN k % 3 = 0 THEN 'part_time' ELSE 'full_time_permanent' END)", salary=f"'EUR ' || {MONEY}"))
add("a9_reed", "reed", lambda: doc(jobId=F.col("k"), jobTitle=F.col("title"), employerName=F.col("company"), locationName=F.col("town"), date=F.date_format("at", "dd/MM/yyyy"), minimumSalary=F.col("low").cast("double"), maximumSalary=F.col("low").cast("double"), jobDescription=F.lit("<p>Do this.</p><ul><li>And that</li></ul>"), contractType=some(pick("Permanent", "Contract", "Temporary", "")), partTime=F.col("k") % 5 == 0, fullTime=F.col("k") % 5 > 0),
    expected(country="'GB'", types="nullif(concat_ws(',', CASE WHEN k % 5 = 0 THEN 'part_time' END, CASE WHEN k % 4 = 0 AND k % 5 > 0 THEN 'full_time_permanent' END, CASE WHEN k % 4 = 1 THEN 'freelance_or_contract' END, CASE WHEN k % 4 IN (1, 2) THEN 'fixed_term' END), '')", salary=f"'GBP ' || {MONEY}"))
add("a10_teachingvacancies", "teachingvacancies", lambda: doc(url=F.col("url"), title=F.col("title"), jobLocation=F.array(st(address=st(addressLocality=F.col("town"), postalCode=F.lit("CB1 1AA")))), datePosted=F.col("day"), hiringOrganization=st(name=F.col("company")), description=F.lit("<p>Do this.</p><ul><li>And that</li></ul>"), employmentType=F.when(F.col("k") % 2 == 0, F.array(F.lit("FULL_TIME"), F.lit("TEMPORARY"))).otherwise(F.array(F.lit("FULL_TIME"))), validThrough=F.col("day")),
    expected(place="town || ' CB1 1AA'", country="'GB'", types=psql("fixed_term", "full_time_permanent")))
add("a12_leforem", "leforem", lambda: doc(numerooffreforem=F.col("k").cast("string"), titreoffre=F.col("title"), lieuxtravailregionnuts=F.array(F.lit("BE21")), lieuxtravaillocalite=F.array(F.upper("town")), datedebutdiffusion=F.col("day"), nomemployeur=F.col("company"), typecontrat=pick("Durée indéterminée", "Durée déterminée"), regimetravail=pick("Temps plein", "Temps plein", "Temps partiel")),
    expected(country="'BE'", types="nullif(concat_ws(',', CASE WHEN k % 3 = 2 THEN 'part_time' END, CASE WHEN k % 2 = 0 AND k % 3 <> 2 THEN 'full_time_permanent' END, CASE WHEN k % 2 = 1 THEN 'fixed_term' END), '')"))
add("a14_nav", "nav", lambda: doc(status=F.when(F.col("status") == "P", "INACTIVE").otherwise("ACTIVE"), ad_content=st(uuid=F.col("k").cast("string"), title=F.col("title"), published=F.concat("day", F.lit("T00:00:00")), applicationDue=F.lit("Snarest"), workLocations=F.array(st(city=F.upper("town"), country=pick("NORGE", "SVERIGE"))), employer=st(name=F.col("company")), engagementtype=pick("Fast", "Vikariat"), extent=pick("Heltid", "Deltid", "Heltid"), description=F.lit("<p>Do this.</p><ul><li>And that</li></ul>"), contactList=F.array(st(name=F.lit("x"))))),
    expected(country="CASE WHEN k % 2 = 0 THEN 'NO' END", types="nullif(concat_ws(',', CASE WHEN k % 3 = 1 THEN 'part_time' END, CASE WHEN k % 2 = 0 AND k % 3 <> 1 THEN 'full_time_permanent' END, CASE WHEN k % 2 = 1 THEN 'fixed_term' END), '')", where="status <> 'P'"))
add("a15_ashby", "ashby", lambda: doc(id=F.col("k").cast("string"), title=F.col("title"), company=F.col("company"), isListed=F.col("status") != "P", location=F.col("town"), address=st(postalAddress=st(addressCountry=F.lit("France"))), secondaryLocations=F.array(st(location=F.lit("Lyon"))), publishedAt=F.concat("day", F.lit("T01:02:03.123+02:00")), employmentType=pick("FullTime", "PartTime", "Intern"), workplaceType=some(pick("Remote", "", "Hybrid")), isRemote=F.col("k") % 3 == 1),
    expected(place="town || ', France; Lyon'", posted="epoch(date_trunc('day', dt)) - 7200 + 3723", precision="'exact'", types=psql("full_time_permanent,fixed_term", "part_time", "internship_or_working_student"), mode=psql("remote", "remote", "hybrid"), where="status <> 'P'"))
add("a16_greenhouse", "greenhouse", lambda: doc(id=F.col("k"), title=F.col("title"), company=F.col("company"), location=st(name=F.concat(F.lit("Remote "), "town")), updated_at=F.concat("day", F.lit("T00:00:00-04:00")), content=F.lit("&lt;p&gt;Text&lt;/p&gt;")),
    expected(place="'Remote ' || town", posted="epoch(date_trunc('day', dt)) + 14400", precision="'exact'", mode="'remote'"))
add("a17_lever", "lever", lambda: doc(id=F.col("k").cast("string"), text=F.col("title"), company=F.col("company"), categories=st(allLocations=F.when(F.col("k") % 2 == 0, F.array("town", F.lit("Oslo"))).otherwise(F.array("town")), commitment=pick("Full-time", "Contractor")), createdAt=F.unix_millis("at"), country=F.lit("fr"), workplaceType=pick("remote", "on-site", "hybrid")),
    expected(place="CASE WHEN k % 2 = 0 THEN town || '; Oslo' ELSE town END", country="CASE WHEN k % 2 = 1 THEN 'FR' END", posted="epoch(dt)", precision="'exact'", types=psql("full_time_permanent,fixed_term", "freelance_or_contract,fixed_term"), mode=psql("remote", "on_site", "hybrid")))
add("a18_recruitee", "recruitee", lambda: doc(id=F.col("k"), title=F.col("title"), company_name=F.col("company"), locations=F.array(st(city=F.col("town"), country=F.lit("Spain"), country_code=F.lit("es")), st(city=F.lit("Faro"), country=pick("Spain", "Portugal"), country_code=pick("es", "pt"))), published_at=F.concat("day", F.lit(" 10:00:00 UTC")), remote=F.col("k") % 3 == 0, hybrid=F.col("k") % 2 == 0, on_site=F.lit(False)),
    expected(place="town || ', Spain; Faro, ' || " + psql("Spain", "Portugal"), country="CASE WHEN k % 2 = 0 THEN 'ES' END", posted="epoch(date_trunc('day', dt)) + 36000", precision="'exact'", types="''", mode="CASE WHEN k % 3 = 0 THEN 'remote' WHEN k % 2 = 0 THEN 'hybrid' END"))
add("a19_workable", "workable", lambda: doc(shortcode=F.col("k").cast("string"), title=F.col("title"), company=F.col("company"), locations=F.array(st(city=F.col("town"), country=F.lit("Italy"), countryCode=F.lit("IT"))), published_on=F.col("day"), employment_type=F.lit("Temporary"), telecommuting=F.col("k") % 2 == 0),
    expected(place="town || ', Italy'", country="'IT'", types="'fixed_term'", mode="CASE WHEN k % 2 = 0 THEN 'remote' END"))
add("a21_dvinci", "dvinci", lambda: doc(id=F.col("k"), position=F.col("title"), company=F.col("company"), jobOpening=st(createdDate=F.col("day"), type=pick("Festanstellung", "Praktikum"), contractPeriod=pick("unlimited", "unlimited", "fixed"), workingTimes=F.array(F.lit("full_time")), locations=F.array(st(name=F.col("town"), latitude=F.lit(1.5), longitude=F.lit(2.5))))),
    expected(types="CASE WHEN k % 2 = 1 THEN 'internship_or_working_student' WHEN k % 3 = 2 THEN 'fixed_term' ELSE 'full_time_permanent' END"))
add("a22_prospective", "prospective", lambda: doc(id=F.col("k").cast("string"), title=F.col("title"), company=F.col("company"), start_date=F.col("day"), szas=st(pensum_min=(F.col("k") % 101).cast("int"), pensum_max=F.lit(100), city=F.when(F.col("k") % 2 == 0, F.col("town")))),
    expected(place="CASE WHEN k % 2 = 0 THEN town END", country="CASE WHEN k % 2 = 1 THEN 'CH' END", types="CASE WHEN k % 101 < 90 THEN 'part_time,full_time_permanent' ELSE 'full_time_permanent' END"))
add("a25_workday", "workday", lambda: doc(title=F.col("title"), company=F.col("company"), externalPath=F.concat(F.lit("/job/x/"), F.col("k").cast("string")), locationsText=F.when(F.col("k") % 2 == 0, F.lit("5 Locations")).otherwise(F.col("town")), postedOn=F.lit("Posted 3 Days Ago"), seen_on=F.col("day")),
    expected(place="CASE WHEN k % 2 = 1 THEN town END", posted=NOON + " - 3 * 86400", types="''"))


def rss(**fields):
    return F.concat(F.lit("<item>"), *(x for k, v in fields.items() for x in (F.lit(f"<{k}>"), v, F.lit(f"</{k}>"))), F.lit("</item>"))


add("a5_servicebund", "servicebund", lambda: rss(title=F.col("title"), link=F.concat("url", F.lit(".html#x")), pubDate=F.concat(F.lit("Mon, "), F.date_format("at", "dd MMM yyyy"), F.lit(" 00:00:00 +0100")), description=F.concat(F.lit("&lt;p&gt;Arbeitgeber: "), "company", F.lit("&lt;/p&gt;&lt;p&gt;Ort: 01069 "), "town", F.lit("&lt;/p&gt;&lt;p&gt;Bewerbungsfrist: 1.2.2000&lt;/p&gt;"))),
    expected(place="'01069 ' || town", country="'DE'"))
add("a11_nhsjobs", "nhsjobs", lambda: rss(id=F.col("k").cast("string"), title=F.col("title"), employer=F.col("company"), locations=F.concat(F.lit("<location>"), "town", F.lit("</location><location>Leeds</location>")), postDate=F.concat("day", F.lit("T12:00:00.123456789")), type=F.lit("Permanent"), salary=F.concat(F.lit("£"), F.col("low").cast("string"), F.lit(".00"))),
    expected(place="town || '; Leeds'", country="'GB'", posted="floor(epoch(timezone('Europe/London', date_trunc('day', dt) + INTERVAL 12 HOUR)))", precision="'exact'", types="'full_time_permanent'", salary="'£' || CAST(low AS VARCHAR)"))
add("a20_teamtailor", "teamtailor", lambda: rss(title=F.col("title"), link=F.col("url"), guid=F.col("k").cast("string"), pubDate=F.concat(F.lit("Tue, "), F.date_format("at", "dd MMM yyyy"), F.lit(" 10:00:00"), pick(" +0200", "")), remoteStatus=F.lit("fully"), locations=F.concat(F.lit("<location><city>"), "town", F.lit("</city><country>Sweden</country></location>"))),
    expected(company="NULL", place="town || ', Sweden'", posted="CASE WHEN k % 2 = 0 THEN epoch(date_trunc('day', dt)) + 28800 END", precision="CASE WHEN k % 2 = 0 THEN 'exact' ELSE 'unknown' END", mode="'remote'"))
add("a24_successfactors", "successfactors", lambda: rss(title=F.concat("title", F.lit(" (Berlin, DE)")), id=F.col("k").cast("string"), link=F.col("url"), location=F.concat("town", F.lit(", "), pick("DE", "UK"), F.lit(", 10115")), employer=F.col("company")),
    expected(place="town || ', ' || " + psql("DE", "UK"), country=psql("DE", "GB"), posted="NULL", precision="'unknown'"))


def _page(spark, d):
    posting = doc(**{"@type": F.lit("JobPosting"), "title": F.col("title"), "datePosted": F.col("day"), "hiringOrganization": st(name=F.col("company")), "jobLocation": st(address=st(addressLocality=F.col("town"), addressCountry=F.lit("NL"))), "employmentType": F.lit("FULL_TIME"), "jobLocationType": F.when(F.col("k") % 2 == 0, "TELECOMMUTE")})
    graph = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"@graph":[{"@type":"Organization"},'), posting, F.lit("]}"))).when(F.col("k") % 3 == 1, F.concat(F.lit("["), posting, F.lit("]"))).otherwise(posting)
    html = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), graph, F.lit("</script><p>Whole page</p></html>"))
    return base(spark, d).select(html.alias("payload"), "url")


@query("a13_a23_a26_linked_page", expected(country="'NL'", types="'full_time_permanent,fixed_term'", mode="CASE WHEN k % 2 = 0 THEN 'remote' END"))
def a26(spark, d):
    return shown("werkenvoornederland", _page(spark, d))


@query("a26_posting_facts", f"WITH {BASE} SELECT url, title, town FROM base")
def a26b(spark, d):
    p = _page(spark, d).withColumn("p", job_posting(F.col("payload")))
    return p.select("url", fact(F.col("p"), "$.title").alias("title"), fact(F.col("p"), "$.jobLocation.address.addressLocality").alias("town"))


@query("a27_html_to_text")
def a27(spark, d):
    return table(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query("a28_sitemap", f"WITH {BASE} SELECT url, CASE WHEN k % 4 > 0 THEN CAST(epoch(date_trunc('day', dt)) AS BIGINT) END AS lastmod FROM base WHERE k % 4 = 0 OR dt >= TIMESTAMP '1998-01-01'")
def a28(spark, d):
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc>"), F.when(F.col("k") % 4 > 0, F.concat(F.lit("<lastmod>"), "day", F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"))
    maps = base(spark, d).groupBy((F.col("k") % 200).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("payload"))
    return sitemap_changed_since(maps, F.to_timestamp(F.lit("1998-01-01"))).select("url", F.unix_seconds("lastmod").alias("lastmod"))


@query("a32_wanted_list", f"WITH {BASE} SELECT company, title, CASE WHEN k % 2 = 0 THEN town END AS place, CAST(NULL AS VARCHAR) AS url FROM base WHERE k % 5 > 0")
def a32(spark, d):
    line = F.when(F.col("k") % 5 == 0, F.concat(F.lit("# "), "company")).otherwise(F.concat_ws(" | ", "company", "title", F.when(F.col("k") % 2 == 0, F.col("town"))))
    return read_wanted(base(spark, d).select(line.alias("value")))


@query("a33_union_sources", f"WITH {BASE} SELECT source, count(*) AS n FROM (SELECT 'greenhouse' AS source FROM base UNION ALL SELECT 'workable' FROM base) GROUP BY 1")
def a33(spark, d):
    g = NORMALISERS["greenhouse"](base(spark, d).select(doc(id=F.col("k"), title=F.col("title")).alias("payload")))
    w = NORMALISERS["workable"](base(spark, d).select(doc(shortcode=F.col("k").cast("string"), title=F.col("title")).alias("payload")))
    return union_sources([g, w]).groupBy("source").agg(F.count("*").alias("n"))


@query("a35_prune_sources", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'disabled' WHEN s_suppkey % 5 = 0 THEN 'unavailable' WHEN s_nationkey % 4 IN (1, 2) THEN 'searched' ELSE 'other countries' END AS status FROM supplier")
def a35(spark, d):
    k = F.col("s_suppkey")
    control = table(spark, d, "supplier").select(k, (k % 7 > 0).alias("enabled"), F.when(k % 5 == 0, "no key").alias("unavailable_reason"), F.array(F.concat(F.lit("C"), (F.col("s_nationkey") % 4).cast("string"))).alias("countries"))
    return prune_sources(control, ["C1", "C2"]).select("s_suppkey", "status")


@query("a37_merge_details", f"WITH {BASE} SELECT CAST(k AS VARCHAR) AS source_job_id, CASE WHEN k % 3 = 0 THEN 'a much longer text' ELSE 'short text' END AS description, CASE WHEN k % 2 = 0 THEN 'part_time' WHEN k % 3 = 0 THEN 'from page' END AS kind FROM base")
def a37(spark, d):
    a = base(spark, d).select(F.lit("s").alias("source"), F.col("k").cast("string").alias("source_job_id"), F.lit("short text").alias("description"), F.when(F.col("k") % 2 == 0, "part_time").alias("kind"))
    page = base(spark, d).where(F.col("k") % 3 == 0).select(F.lit("s").alias("source"), F.col("k").cast("string").alias("source_job_id"), F.lit("a much longer text").alias("description"), F.lit("from page").alias("kind"))
    return merge_details(a, page).select("source_job_id", "description", "kind")


@query("c19_robots", "SELECT DISTINCT url, NOT (url LIKE '%.example.net/%' OR (url LIKE '%.example.com/de/%')) AS allowed FROM pages")
def c19(spark, d):
    pages = table(spark, d, "pages").select("url")
    hosts = pages.select(F.parse_url("url", F.lit("HOST")).alias("host")).distinct()
    rule = lambda c, pattern, allow: F.when(c, F.struct(F.lit("*").alias("agent"), F.lit(pattern).alias("pattern"), F.lit(allow).alias("allow")))
    net, com = F.col("host").endswith(".example.net"), F.col("host").endswith(".example.com")
    robots = hosts.select("host", F.explode(F.filter(F.array(rule(net, "/", False), rule(com, "/de/", False), rule(com, "/", True)), lambda x: x.isNotNull())).alias("r")).select("host", "r.*")
    return admitted(pages, robots, "adweave")


def pages_of(rows, block, head=None):
    """Result pages of ten orders each."""
    listed = F.collect_list(F.struct("k", block.alias("b"), (F.lit("") if head is None else head).alias("h")))
    page = rows.groupBy(F.floor(F.col("k") / 10).alias("page")).agg(F.array_sort(listed).alias("x"))
    return page.select(F.concat(F.lit("<html><ul id='longlats'>"), F.array_join("x.h", ""), F.lit("</ul>"), F.array_join("x.b", "\n"), F.lit("</html>")).alias("payload"))


def shape(rows):
    return rows.withColumn("posted", F.unix_seconds("posted_at")).withColumn("types", F.array_join("job_types", ",")).select(*SHOWN)


@query("a6_euraxess_list", expected(place="'Street 1, ' || town", country=psql("ES", "FR", None).replace("'None'", "NULL")))
def a6(spark, d):
    """Labels name one country, one country twice, or two."""
    labels = F.when(F.col("k") % 3 == 0, "<span class='x ecl-label'>Spain</span><span class='ecl-label'>Permanent</span>").when(F.col("k") % 3 == 1, "<span class='ecl-label'>France</span><span class='ecl-label'>France</span>").otherwise("<span class='ecl-label'>France</span><span class='ecl-label'>Spain</span>")
    block = F.concat(
        F.lit("<div id='job-teaser-content'><ul><li class='ecl-content-block__primary-meta-item'><a href='/o'>"), "company", F.lit("</a></li><li class='ecl-content-block__primary-meta-item'>Posted on: "), F.date_format("at", "d MMMM yyyy"),
        F.lit("</li></ul>"), labels, F.lit("<h3 class='ecl-content-block__title'><a href='/jobs/"), F.col("k").cast("string"), F.lit("'><b>"), "title", F.lit("</b></a></h3><div class='id-Work-Locations'>Work Locations: Number of offers: 2, Street 1, "), "town", F.lit("</div></div>"),
    )
    names = spark.createDataFrame([("Spain", "ES"), ("France", "FR")], "name string, code string")
    return shape(euraxess_list(pages_of(base(spark, d), block), names))


LEAP_DAY = "strftime(dt, '%m-%d') = '02-29'"


@query("a7_jobsacuk_list", expected(posted=f"CASE WHEN {LEAP_DAY} THEN NULL ELSE CAST(epoch(make_date(CASE WHEN strftime(dt, '%m-%d') <= '07-01' THEN 2023 ELSE 2022 END, month(dt), CASE WHEN {LEAP_DAY} THEN 28 ELSE day(dt) END)) AS BIGINT) + 43200 END", precision=f"CASE WHEN {LEAP_DAY} THEN 'unknown' ELSE 'day' END", salary="'£' || CAST(low AS VARCHAR) || ' · Grade 9'"))
def a7(spark, d):
    """Seen on 30 June 2023: a day up to 1 July is of that year, a later one of the year before, and
    29 February is in neither."""
    block = F.concat(
        F.lit("<div class='j-search-result__result ' data-advert-id='"), F.col("k").cast("string"), F.lit("'><a href='/job/X1/'>"), "title", F.lit("</a><div class='j-search-result__employer'>"), "company", F.lit("</div><div>Location: "), "town",
        F.lit("</div><div class='j-search-result__info'>Salary: £"), F.col("low").cast("string"), F.lit("<br>Grade 9</div><div><strong>Date Placed:</strong> "), F.date_format("at", "dd MMM"), F.lit("</div></div>"),
    )
    return shape(jobsacuk_list(pages_of(base(spark, d), block).withColumn("seen_on", F.lit("2023-06-30"))))


#: Irish summer time: from March's last Sunday to October's, which was October's fourth one until 1995.
SUNDAY_FROM = "(make_date(year(dt), {0}, {1}) + CAST((7 - dayofweek(make_date(year(dt), {0}, {1}))) % 7 AS INTEGER))"
SUMMER = f"dt >= {SUNDAY_FROM.format(3, 25)} AND dt < CASE WHEN year(dt) < 1996 THEN {SUNDAY_FROM.format(10, 22)} ELSE {SUNDAY_FROM.format(10, 25)} END"


@query(
    "a8_jobsireland_list",
    f"""WITH {BASE}, s AS (SELECT *, CASE WHEN {SUMMER} THEN 3600 ELSE 0 END AS ahead FROM base)
    SELECT CAST(k AS VARCHAR) AS source_job_id, title, company, town AS location_text, CASE k % 3 WHEN 0 THEN 'part_time' WHEN 1 THEN 'freelance_or_contract' ELSE NULL END AS types, CASE WHEN k % 2 = 0 THEN k / 100.0 END AS latitude,
    CAST(epoch(date_trunc('day', dt)) AS BIGINT) + 32400 - ahead AS posted, CAST(epoch(date_trunc('day', dt)) AS BIGINT) + 86340 - ahead AS closes, '€' || format('{{:,}}', low) || ' a year' AS salary, CASE WHEN k % 40 >= 30 THEN 'full_time_permanent,fixed_term' ELSE 'part_time' END AS hours FROM s""",
)
def a8(spark, d):
    """Days of all the year, in summer an hour ahead of UTC; the coordinates of every second job are on the page."""
    field = lambda n, v: F.concat(F.lit(f"<input type='hidden' id='{n}' value='"), v, F.lit("'>"))
    k = F.col("k").cast("string")
    block = F.concat(F.lit("<div class='job-heading' data-vacancyid='1'><img alt='Logo of "), "company", F.lit("'>"), field("JobId", k), field("JobTitle", F.col("title")), field("Location", F.concat("town", F.lit(", "))), field("StartDate", F.concat("day", F.lit("T09:00:00"))), field("EndDate", F.concat("day", F.lit("T00:00:00"))), field("VacancyTypeId", by_key(F.col("k"), ["3", "6", "0"])), F.lit("</div>"))
    head = F.when(F.col("k") % 2 == 0, F.concat(F.lit("<li>"), (F.col("k") / 100.0).cast("string"), F.lit(";-6.5;x;"), k, F.lit(";y</li>"))).otherwise("")
    rows = base(spark, d)
    said = rows.select(k.alias("source_job_id"), euro_salary(F.concat(F.col("low").cast("string"), F.lit(".00 Euro Annually"))).alias("salary"), F.array_join(types_from_hours(F.concat((F.col("k") % 40).cast("string"), F.lit(" hours a week"))), ",").alias("hours"))
    listed = jobsireland_list(pages_of(rows, block, head))
    return listed.select("source_job_id", "title", "company", "location_text", F.array_join("job_types", ",").alias("types"), "latitude", F.unix_seconds("posted_at").alias("posted"), F.unix_seconds("closes_at").alias("closes")).join(said, "source_job_id")


@query(
    "a25_f9_facets",
    """WITH b AS (SELECT s_suppkey AS board, s_suppkey % 4 AS form, s_nationkey AS a, (s_nationkey + 7) % 25 AS b FROM supplier)
    SELECT board, CASE form WHEN 0 THEN 'locationCountry' WHEN 1 THEN 'locations' WHEN 2 THEN 'locationHierarchy1' END AS parameter, country, CAST(jobs AS BIGINT) AS jobs
    FROM (SELECT board, form, 'C' || a AS country, CASE form WHEN 1 THEN 5 ELSE 10 + board % 7 END AS jobs FROM b WHERE form < 3
      UNION ALL SELECT board, form, 'C' || b, 3 FROM b WHERE form IN (0, 2)
      UNION ALL SELECT board, form, 'C' || b, 4 FROM b WHERE form = 1
      UNION ALL SELECT board, form, 'other', 2 FROM b WHERE form IN (1, 2))""",
)
def a25_facets(spark, d):
    """Each supplier's site with nested filters of one of four kinds: which stands for countries, and jobs by country."""
    from adweave.sources.facets import country_facets, facet_survey, facet_values

    n = table(spark, d, "nation").select("n_nationkey", F.initcap("n_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("board"), (F.col("s_suppkey") % 4).alias("form"), F.col("s_nationkey").alias("a"), ((F.col("s_nationkey") + 7) % 25).alias("b"))
    name = lambda k, as_: n.select(F.col("n_nationkey").alias(k), F.col("name").alias(as_))
    s = s.join(name("a", "a_name"), "a").join(name("b", "b_name"), "b")
    value = lambda id_, text, count: st(id=F.lit(id_), descriptor=text, count=F.lit(count) if isinstance(count, int) else count)
    facet = lambda parameter, *values: st(facetParameter=F.lit(parameter), values=F.array(*values))
    # every list of one array has one shape in Spark, so the page's parts are written one by one
    plain = lambda *x: F.concat(F.lit("["), *(p for k, v in enumerate(x) for p in ((F.lit(","),) if k else ()) + (F.to_json(v),)), F.lit("]"))
    inside = lambda parameter, text: F.concat(F.lit('{"facetParameter":"%s","values":' % parameter), text, F.lit("}"))
    many = F.lit(10) + F.col("board") % 7
    family = facet("jobFamily", value("f1", F.col("a_name"), 3))
    countries = facet("locationCountry", value("c1", F.col("a_name"), many), value("c2", F.col("b_name"), 3))
    offices = facet("locations", value("o1", F.concat("a_name", F.lit(", Town")), 5), value("o2", F.concat("b_name", F.lit(", Other Town")), 4), value("o3", F.lit("Remote"), 2))
    upper = facet("locationHierarchy1", value("h1", F.col("a_name"), many), value("h2", F.col("b_name"), 3), value("h3", F.lit("Atlantis"), 2))
    vague = facet("locations", value("v1", F.lit("Campus"), 1), value("v2", F.col("a_name"), 1))
    page = F.when(F.col("form") == 0, plain(family, offices, countries)).when(F.col("form") == 1, F.concat(F.lit("["), inside("locationMainGroup", F.concat(F.lit("["), inside("deeper", plain(offices)), F.lit("]"))), F.lit("]")))
    page = page.when(F.col("form") == 2, F.concat(F.lit("["), F.to_json(vague), F.lit(","), inside("locationMainGroup", plain(upper)), F.lit("]"))).otherwise(plain(family, vague))
    facets = facet_values(s.select("board", F.concat(F.lit('{"facets":'), page, F.lit("}")).alias("payload")))
    places = n.select("name", F.concat(F.lit("C"), "n_nationkey").alias("code"))
    chosen = country_facets(facets, places)
    from adweave.plans.adapters import towns
    from adweave.plans.place_queries import regions

    jobs, _ = facet_survey(facets, chosen, places, towns(spark, d), regions(spark))
    return jobs.join(chosen.select("board", "parameter").distinct(), "board").select("board", "parameter", "country", "jobs")


@query(
    "a8_jobsireland_details",
    f"""WITH {BASE} SELECT CAST(k AS VARCHAR) AS source_job_id, CASE WHEN k % 5 = 0 THEN company ELSE company || ' Ltd' END AS company, CASE WHEN k % 5 = 0 THEN NULL ELSE 'Text of ' || title || chr(10) || chr(10) || 'and more' END AS description,
    CASE WHEN k % 2 = 0 THEN 'part_time' WHEN k % 5 = 0 THEN NULL WHEN k % 40 >= 30 THEN 'full_time_permanent,fixed_term' ELSE 'part_time' END AS types, CASE WHEN k % 5 > 0 THEN '€' || {MONEY} || ' a year' END AS salary_text, k % 5 > 0 AS complete FROM base""",
)
def a8_details(spark, d):
    """The list's jobs with their own pages, whose elements are nested; every fifth page has no text of the ad."""
    from adweave.sources.lists import jobsireland_details, with_irish_details

    k = F.col("k").cast("string")
    item = lambda icon, text: F.concat(F.lit(f"<li><img src='x' alt='{icon}'><div class='name'>{icon}</div><div>"), text, F.lit("</div></li>"))
    facts = F.concat(F.lit("<ul class='x job-detail_list'>"), item("Employer", F.concat(F.lit("<div></div>"), "company", F.lit(" Ltd"))), item("Hours a week", F.concat((F.col("k") % 40).cast("string"), F.lit(".0 hours"))), item("Euro", F.concat(F.col("low").cast("string"), F.lit(".00 Euro Annually"))), F.lit("</ul>"))
    text = F.when(F.col("k") % 5 > 0, F.concat(F.lit("<pre ng-bind-html='job.Description'>Text of "), "title", F.lit("<pre></pre>\nand more</pre>"))).otherwise("<pre>other</pre>")
    rows = base(spark, d)
    details = jobsireland_details(rows.select(k.alias("source_job_id"), F.concat(F.lit("<html>"), text, facts, F.lit("</html>")).alias("payload")))
    ads = rows.select(k.alias("source_job_id"), "company", F.lit(None).cast("string").alias("description"), F.when(F.col("k") % 2 == 0, F.array(F.lit("part_time"))).alias("job_types"), F.lit(None).cast("string").alias("salary_text"), F.lit(False).alias("description_is_complete"))
    return with_irish_details(ads, details).select("source_job_id", "company", "description", F.array_join("job_types", ",").alias("types"), "salary_text", F.col("description_is_complete").alias("complete"))


@query(
    "a24_addresses",
    f"""WITH {BASE} SELECT 'b' || k % 9 || '/' || k AS source_job_id, CASE k % 3 WHEN 0 THEN 'Clerk' ELSE c.name || ' Clerk' END AS title,
    CASE k % 4 WHEN 0 THEN 'Walldorf, Germany' WHEN 1 THEN 'Leeds' ELSE CASE WHEN k % 3 > 0 THEN c.name END END AS location_text, CASE k % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'GB' ELSE CASE WHEN k % 3 > 0 THEN c.country ELSE 'other' END END AS country,
    CASE WHEN k % 4 < 2 THEN 'Do this' ELSE '' END AS description, CASE WHEN k % 4 < 2 THEN {NOON} END AS posted
    FROM base JOIN (SELECT c_custkey, 'Customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, 'N' || CAST(c_nationkey % 3 AS VARCHAR) AS country FROM customer) c ON c.c_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = k)""",
)
def a24_addresses(spark, d):
    """Orders as pages of nine sites, by their addresses; half of the pages mark their facts."""
    from adweave.plans.adapters import towns
    from adweave.sources.slugs import jobs_of_addresses, with_page_marks

    k = F.col("k")
    rows = base(spark, d).withColumn("slug", F.when(k % 3 == 0, F.lit("Clerk")).otherwise(F.concat(F.lit("Customer-"), F.substring("company", 10, 9), F.lit("-Clerk-69190"))))
    rows = rows.withColumn("page", F.concat(F.lit("https://b"), (k % 9).cast("string"), F.lit(".example.org/job/"), "slug", F.lit("/"), k.cast("string"), F.lit("/")))
    place = F.when(k % 4 == 0, "Walldorf, DE, 69190").otherwise("Leeds, UK")
    marks = F.concat(F.lit("<div><meta itemprop='streetAddress' content='"), place, F.lit("'><div itemprop='description'><div>Do</div> this</div><meta itemprop=\"datePosted\" content=\""), "day", F.lit("\"></div>"))
    pages = rows.select(F.col("page").alias("url"), F.when(k % 4 < 2, marks).otherwise("<p>nothing</p>").alias("payload"))
    named = towns(spark, d).withColumn("names", F.transform("names", lambda n: F.replace(n, F.lit("#"), F.lit(" "))))
    jobs = jobs_of_addresses(rows.select(F.concat(F.lit("b"), (k % 9).cast("string")).alias("board"), F.col("page").alias("url")), named)
    out = with_page_marks(jobs, pages, F.create_map(F.lit("DE"), F.lit("Germany")))
    return out.select("source_job_id", "title", "location_text", "country", F.regexp_replace("description", "\\s+", " ").alias("description"), F.unix_seconds("posted_at").alias("posted"))
