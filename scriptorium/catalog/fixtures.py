"""Derived inputs over the given tables, once for Spark and once as SQL text.

The given tables hold prose, orders and events. The views below turn *all* of their rows
into the tables this engine works on: word boxes, headings, ink measurements, answer boxes,
label saves. No view filters rows by id; variation comes from arithmetic on the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import spread

VIEWS: dict[str, str] = {
    "fx_lines": """
        select doc_id, lang, source, cast(line_number as int) line_number, line
        from (select doc_id, lang, source, generate_subscripts(a,1) line_number, unnest(a) line
              from (select doc_id, lang, source, string_split(text, chr(10)) a from documents))""",
    "fx_pairs": """
        select doc_id, line_number, lang, source, line ref_text,
          case when (doc_id+line_number)%17=0 then ''
               when line='' and (doc_id+line_number)%2=0 then 'ghost'
               when (doc_id+line_number)%3=0 then replace(line,'th','lh')
               when (doc_id+line_number)%3=1 then replace(line,' the ',' ')
               else translate(line,'oOlI','0011') end pred_text
        from fx_lines""",
    "fx_pages": """
        select cast(floor(doc_id/8) as bigint) paper_id, cast(doc_id%8+1 as int) page_number,
          cast(1000 as int) width, cast(1400 as int) height from documents""",
    "fx_body": """
        select cast(floor(doc_id/8) as bigint) paper_id, cast(doc_id%8+1 as int) page_number,
          cast(line_number*100000+wn as int) word_index, word as text,
          case when (doc_id+wn)%23=0 then null
               else cast((doc_id*31+line_number*7+wn*13)%101 as double)/100 end confidence,
          cast(40+((wn-1)*70)%900 as int) x, cast(40+((line_number-1)*45)%1300+wn%3 as int) y,
          cast(10+5*least(length(word),9) as int) width, cast(30+length(word)%7 as int) height,
          case when doc_id%5=4 then null when doc_id%7=3 then 0 else cast(floor((line_number-1)/8)+1 as int) end block_number,
          case when doc_id%5=4 then null else cast(floor((line_number-1)/3) as int)%3+1 end paragraph_number,
          case when doc_id%5=4 then null else line_number end line_number,
          case when doc_id%5=4 then null else cast(wn as int) end word_number
        from (select doc_id, line_number, generate_subscripts(w,1) wn, unnest(w) word
              from (select doc_id, line_number, string_split(line,' ') w from fx_lines))
        where trim(word)<>''""",
    "fx_headings": """
        select doc_id, cast(floor(doc_id/8) as bigint) paper_id, cast(doc_id%8+1 as int) page_number,
          cast(k as int) k, cast(2*(doc_id%8)+k as int) true_number,
          case when (doc_id+k)%11=0 then 'zzzz' else case (doc_id+k)%6 when 0 then 'Test' when 1 then 'TEST' when 2 then 'lest' when 3 then 'Test'
            when 4 then 'Text' else 'Best1' end end kw,
          case when (doc_id+k)%5=0 then replace(lpad(cast(2*(doc_id%8)+k as varchar),2,'0'),'0','O')
               else lpad(cast(2*(doc_id%8)+k as varchar),2,'0') end num,
          cast(60+(doc_id%9)*80 as int) x,
          cast(case when k=1 then 40+doc_id%50 else 700+doc_id%90 end as int) y,
          cast((doc_id*7+k*11)%101 as int) conf
        from (select doc_id, unnest([1,2]) k from documents)""",
    "fx_words": """
        select paper_id, page_number, word_index, text, confidence, x, y, width, height,
          block_number, paragraph_number, line_number, word_number from fx_body
        union all
        select paper_id, page_number, cast(k*10 as int), kw, cast(conf as double)/100, x, y, 80, 40,
          900+k, 1, 1, 1 from fx_headings
        union all
        select paper_id, page_number, cast(k*10+1 as int), num, cast(conf as double)/100, x+100, y, 50, 40,
          900+k, 1, 1, 2 from fx_headings""",
    "fx_evidence": """
        select l_orderkey, l_linenumber, cast(l_orderkey%500 as bigint) page_id,
          cast(l_partkey%101 as double)/100 red, cast(l_suppkey%101 as double)/100 sat, cast((l_partkey*3)%101 as double)/100 blue,
          cast((l_orderkey*7)%101 as double)/100 regularity, cast((l_orderkey*5+l_linenumber)%101 as double)/100 irregularity,
          cast((l_partkey*11)%101 as double)/100 density, cast((l_suppkey*13)%101 as double)/100 fragmentation,
          cast((l_linenumber*17+l_partkey)%101 as double)/100 isolation, cast(l_orderkey%2 as double) margin,
          cast((l_suppkey*7)%101 as double)/100 dark, cast((l_partkey*29)%101 as double)/100 edge, cast(l_suppkey%12 as int) components,
          case when l_linenumber%4=0 then null else cast((l_partkey*19)%101 as double)/100 end ocr_conf
        from lineitem""",
    "fx_components": """
        select cast(floor(doc/8) as bigint) paper_id, cast(doc%8+1 as int) page_number,
          row_number() over (partition by doc order by l_partkey, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) component_no,
          cast((l_suppkey*37)%940 as int) x, cast((l_orderkey*13)%1340 as int) y,
          cast(4+l_linenumber*7 as int) width, cast(4+cast(l_quantity as int)%30 as int) height,
          cast(12+l_quantity*l_linenumber as double) contour_area,
          cast((l_orderkey*7)%101 as double)/400 chroma, cast((l_suppkey*13)%101 as double)/500 saturation,
          cast((l_partkey*29)%101 as double)/1000 edge, cast((l_orderkey*3)%101 as double)/100 whitespace,
          cast(l_orderkey%5 as int) angled
        from (select *, l_partkey%(select count(*) from documents) doc from lineitem)""",
    # Every prediction stays; some are moved off their page, where they overlap nothing.
    "fx_predictions": "select * replace (case when hx%5=0 then px+1000 else px end as px) from fx_numbered_boxes",
    "fx_numbered_boxes": """
        select l_orderkey sample_id,
          cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) box_idx,
          cast(l_partkey%700 as int) hx, cast((l_suppkey*7)%900 as int) hy,
          cast(40+l_quantity*4 as int) hw, cast(30+l_linenumber*10 as int) hh,
          cast(l_partkey%700+l_orderkey%23 as int) px, cast((l_suppkey*7)%900+l_linenumber*3 as int) py,
          cast(40+l_quantity*4-l_orderkey%11 as int) pw, cast(30+l_linenumber*10 as int) ph
        from lineitem""",
    "fx_guides": """
        select l_orderkey paper_id, cast(1 as int) page_number, cast(1 as int) test_number,
          cast(50+l_partkey%60 as int) x, cast(100+(l_linenumber*l_linenumber*9+l_suppkey%37) as int) y,
          cast(400+l_quantity*4 as int) width, cast(2 as int) height
        from lineitem""",
    "fx_region_evidence": """
        select paper_id, page_number, test_number, x, y, width, height, evidence_type,
          cast(row_number() over (partition by paper_id order by y, x, evidence_type, width, height, tie)-1 as int) evidence_no
        from (select l_orderkey paper_id, cast(1 as int) page_number, cast(1 as int) test_number,
            cast((l_partkey*7)%900 as int) x, cast(90+(l_suppkey*11)%470 as int) y,
            cast(20+l_linenumber*9 as int) width, cast(8+l_linenumber*2 as int) height,
            case l_suppkey%3 when 0 then 'printed' when 1 then 'student_candidate' else 'unknown' end evidence_type,
            l_extendedprice tie
          from lineitem)""",
    "fx_labels": """
        select l.doc_id sample_id,
          case when l.toxic=1 then 'teacher_candidate' when l.quality=1 then 'student_candidate' when d.n_chars%2=0 then 'printed' else 'unknown' end human,
          case when d.n_chars%5=0 then 'unknown' when d.n_chars%7=0 then 'printed' when l.quality=1 then 'student_candidate' else 'printed' end predicted,
          d.lang, d.source
        from labels l join documents d on l.doc_id=d.doc_id""",
    "fx_saves": """
        select event_id, ts, concat('sample_', lpad(cast(user_id as varchar),6,'0')) sample_id,
          case event_type when 'view' then 'printed' when 'click' then 'student_candidate' when 'signup' then 'teacher_candidate' else 'unknown' end evidence_type,
          cast(floor(value) as int)%900 x, cast(event_id%700 as int) y, cast(event_id%37 as int) width, cast(20 as int) height,
          event_id%5=0 as is_empty
        from events""",
    # A save is valid when it is an explicit empty statement or its box has a positive width.
    "fx_valid_saves": "select * from fx_saves where is_empty or width>0",
    "fx_current": """
        select * exclude (rn) from (
          select *, row_number() over (partition by sample_id order by ts desc, event_id desc) rn from fx_valid_saves)
        where rn=1""",
    "fx_records": """
        select *, concat('{"answer_regions":[',
          case when is_empty then '' else concat('{"bbox":{"height":',height,',"width":',width,',"x":',x,',"y":',y,'}}') end,
          '],"answer_status":"', case when is_empty then 'verified_empty' else 'annotated' end,
          '","evidence_type":"', evidence_type, '","human_verified":true,"sample_id":"', sample_id, '"}') record
        from fx_valid_saves""",
}


def _int(expression: str):
    return F.expr(f"cast({expression} as int)")


def _hundredth(expression: str, scale: int = 100):
    return F.expr(f"cast(({expression}) as double)") / F.lit(float(scale))


class Fixtures:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        numbered = (
            self.table("documents")
            .select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("p", "line"))
            .select("doc_id", "lang", "source", (F.col("p") + 1).cast("int").alias("line_number"), "line")
        )
        return spread(numbered, "doc_id", "line_number")

    def pairs(self) -> DataFrame:
        n = F.col("doc_id") + F.col("line_number")
        line = F.col("line")
        prediction = (
            F.when(n % 17 == 0, "")
            .when((line == "") & (n % 2 == 0), "ghost")
            .when(n % 3 == 0, F.replace(line, F.lit("th"), F.lit("lh")))
            .when(n % 3 == 1, F.replace(line, F.lit(" the "), F.lit(" ")))
            .otherwise(F.translate(line, "oOlI", "0011"))
        )
        return self.lines().select(
            "doc_id", "line_number", "lang", "source", line.alias("ref_text"), prediction.alias("pred_text")
        )

    def page_key(self, doc: str = "doc_id"):
        return F.expr(f"cast(floor(({doc})/8) as bigint)").alias("paper_id"), _int(f"({doc})%8+1").alias("page_number")

    def pages(self) -> DataFrame:
        return self.table("documents").select(
            *self.page_key(), F.lit(1000).alias("width"), F.lit(1400).alias("height")
        )

    def body(self) -> DataFrame:
        """One row per word of every document."""
        words = (
            self.lines()
            .select("doc_id", "line_number", F.posexplode(F.split("line", " ")).alias("p", "word"))
            .where(F.trim("word") != "")
            .withColumn("wn", F.col("p") + 1)
        )
        bare = F.col("doc_id") % 5 == 4

        def known(value):
            return F.when(~bare, value)

        return words.select(
            *self.page_key(),
            _int("line_number*100000+wn").alias("word_index"),
            F.col("word").alias("text"),
            F.when((F.col("doc_id") + F.col("wn")) % 23 != 0, _hundredth("(doc_id*31+line_number*7+wn*13)%101")).alias("confidence"),
            _int("40+((wn-1)*70)%900").alias("x"),
            _int("40+((line_number-1)*45)%1300+wn%3").alias("y"),
            _int("10+5*least(length(word),9)").alias("width"),
            _int("30+length(word)%7").alias("height"),
            known(F.when(F.col("doc_id") % 7 == 3, 0).otherwise(_int("floor((line_number-1)/8)+1"))).alias("block_number"),
            known(_int("floor((line_number-1)/3)%3+1")).alias("paragraph_number"),
            known(F.col("line_number")).alias("line_number"),
            known(F.col("wn")).alias("word_number"),
        )

    def headings(self) -> DataFrame:
        number = "lpad(cast(2*(doc_id%8)+k as string),2,'0')"
        return (
            self.table("documents")
            .select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
            .select(
                "doc_id",
                *self.page_key(),
                "k",
                _int("2*(doc_id%8)+k").alias("true_number"),
                F.expr(
                    "case when (doc_id+k)%11=0 then 'zzzz' else case (doc_id+k)%6 when 0 then 'Test' when 1 then 'TEST' "
                    "when 2 then 'lest' when 3 then 'Test' when 4 then 'Text' else 'Best1' end end"
                ).alias("kw"),
                F.expr(f"case when (doc_id+k)%5=0 then replace({number},'0','O') else {number} end").alias("num"),
                _int("60+(doc_id%9)*80").alias("x"),
                _int("case when k=1 then 40+doc_id%50 else 700+doc_id%90 end").alias("y"),
                _int("(doc_id*7+k*11)%101").alias("conf"),
            )
        )

    def words(self) -> DataFrame:
        """Body words plus the heading tokens of every page."""
        h = self.headings()

        def token(offset: int, text: str, dx: int, width: int, word: int) -> DataFrame:
            return h.select(
                "paper_id", "page_number",
                (F.col("k") * 10 + offset).alias("word_index"),
                F.col(text).alias("text"),
                _hundredth("conf").alias("confidence"),
                (F.col("x") + dx).alias("x"), "y",
                F.lit(width).alias("width"), F.lit(40).alias("height"),
                (F.col("k") + 900).alias("block_number"),
                F.lit(1).alias("paragraph_number"), F.lit(1).alias("line_number"), F.lit(word).alias("word_number"),
            )

        return self.body().unionByName(token(0, "kw", 0, 80, 1)).unionByName(token(1, "num", 100, 50, 2))

    def evidence(self) -> DataFrame:
        return self.table("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.expr("l_orderkey%500").alias("page_id"),
            _hundredth("l_partkey%101").alias("red"),
            _hundredth("l_suppkey%101").alias("sat"),
            _hundredth("(l_partkey*3)%101").alias("blue"),
            _hundredth("(l_orderkey*7)%101").alias("regularity"),
            _hundredth("(l_orderkey*5+l_linenumber)%101").alias("irregularity"),
            _hundredth("(l_partkey*11)%101").alias("density"),
            _hundredth("(l_suppkey*13)%101").alias("fragmentation"),
            _hundredth("(l_linenumber*17+l_partkey)%101").alias("isolation"),
            F.expr("cast(l_orderkey%2 as double)").alias("margin"),
            _hundredth("(l_suppkey*7)%101").alias("dark"),
            _hundredth("(l_partkey*29)%101").alias("edge"),
            _int("l_suppkey%12").alias("components"),
            F.when(F.col("l_linenumber") % 4 != 0, _hundredth("(l_partkey*19)%101")).alias("ocr_conf"),
        )

    def feature_rows(self) -> DataFrame:
        """Evidence rows with the ink and geometry structs of the classifier."""
        e = self.evidence()
        ink = F.struct(
            F.col("sat").alias("mean_saturation"),
            F.col("red").alias("red_foreground_ratio"),
            F.col("blue").alias("blue_foreground_ratio"),
            F.col("dark").alias("dark_foreground_ratio"),
            F.col("edge").alias("edge_density"),
            F.col("edge").alias("local_contrast"),
            F.col("density").alias("foreground_ratio"),
            F.col("components").alias("connected_component_count"),
        )
        geometry = F.struct(
            "regularity",
            F.col("irregularity").alias("baseline_irregularity"),
            F.col("irregularity").alias("height_irregularity"),
            F.col("fragmentation").alias("spacing_irregularity"),
            F.col("density").alias("line_density"),
            "fragmentation",
            "isolation",
            F.col("margin").alias("margin_position"),
        )
        return e.withColumn("ink", ink).withColumn("geometry", geometry).withColumn("ocr_confidence", F.col("ocr_conf"))

    def components(self) -> DataFrame:
        from pyspark.sql import Window

        # A document is a page: rows dealt by page are not dealt again by what joins them to their page.
        order = Window.partitionBy("paper_id", "page_number").orderBy("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
        return (
            self.table("lineitem")
            .withColumn("_doc", F.col("l_partkey") % F.lit(self.table("documents").count()))
            .select("*", *self.page_key("_doc"))
            .select(
                "paper_id", "page_number",
                F.row_number().over(order).cast("long").alias("component_no"),
                F.struct(
                    _int("(l_suppkey*37)%940").alias("x"), _int("(l_orderkey*13)%1340").alias("y"),
                    _int("4+l_linenumber*7").alias("width"), _int("4+cast(l_quantity as int)%30").alias("height"),
                ).alias("component"),
                F.expr("12+l_quantity*l_linenumber").alias("contour_area"),
                _hundredth("(l_orderkey*7)%101", 400).alias("chromatic_foreground_ratio"),
                _hundredth("(l_suppkey*13)%101", 500).alias("mean_saturation"),
                _hundredth("(l_partkey*29)%101", 1000).alias("edge_density"),
                _hundredth("(l_orderkey*3)%101").alias("local_whitespace_ratio"),
                _int("l_orderkey%5").alias("angled_line_count"),
            )
        )

    def boxes(self) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("sample_id"),
            F.row_number().over(order).cast("int").alias("box_idx"),
            F.struct(
                _int("l_partkey%700").alias("x"), _int("(l_suppkey*7)%900").alias("y"),
                _int("40+l_quantity*4").alias("width"), _int("30+l_linenumber*10").alias("height"),
            ).alias("human_box"),
            F.struct(
                _int("l_partkey%700+l_orderkey%23").alias("x"), _int("(l_suppkey*7)%900+l_linenumber*3").alias("y"),
                _int("40+l_quantity*4-l_orderkey%11").alias("width"), _int("30+l_linenumber*10").alias("height"),
            ).alias("predicted_box"),
        )

    def human_boxes(self) -> DataFrame:
        return self.boxes().select("sample_id", F.col("box_idx").alias("human_idx"), "human_box")

    def predicted_boxes(self) -> DataFrame:
        return self.boxes().select("sample_id", F.col("box_idx").alias("predicted_idx"), "predicted_box")

    def moved_predictions(self) -> DataFrame:
        """Every predicted box, some moved off their page, where they overlap nothing."""
        p = F.col("predicted_box")
        x = F.when(F.col("human_box.x") % 5 == 0, p["x"] + 1000).otherwise(p["x"])
        box = F.struct(x.alias("x"), p["y"].alias("y"), p["width"].alias("width"), p["height"].alias("height"))
        return self.boxes().select("sample_id", F.col("box_idx").alias("predicted_idx"), box.alias("predicted_box"))

    def guides(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page_number"), F.lit(1).alias("test_number"),
            F.struct(
                _int("50+l_partkey%60").alias("x"), _int("100+(l_linenumber*l_linenumber*9+l_suppkey%37)").alias("y"),
                _int("400+l_quantity*4").alias("width"), F.lit(2).alias("height"),
            ).alias("line_box"),
        )

    def guide_regions(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("paper_id")).distinct().select(
            "paper_id", F.lit(1).alias("page_number"), F.lit(1).alias("test_number"),
            F.struct(F.lit(0).alias("x"), F.lit(90).alias("y"), F.lit(1000).alias("width"), F.lit(500).alias("height")).alias("region"),
        )

    def region_evidence(self) -> DataFrame:
        from pyspark.sql import Window

        rows = self.table("lineitem").select(
            F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page_number"), F.lit(1).alias("test_number"),
            F.struct(
                _int("(l_partkey*7)%900").alias("x"), _int("90+(l_suppkey*11)%470").alias("y"),
                _int("20+l_linenumber*9").alias("width"), _int("8+l_linenumber*2").alias("height"),
            ).alias("box"),
            F.expr("case l_suppkey%3 when 0 then 'printed' when 1 then 'student_candidate' else 'unknown' end").alias("evidence_type"),
            F.col("l_extendedprice").alias("tie"),
        )
        order = Window.partitionBy("paper_id").orderBy(
            "box.y", "box.x", "evidence_type", "box.width", "box.height", "tie"
        )
        return rows.withColumn("evidence_no", (F.row_number().over(order) - 1).cast("int")).drop("tie")

    def labels(self) -> DataFrame:
        joined = self.table("labels").join(self.table("documents").drop("text"), "doc_id")
        return joined.select(
            F.col("doc_id").alias("sample_id"),
            F.expr(
                "case when toxic=1 then 'teacher_candidate' when quality=1 then 'student_candidate' "
                "when n_chars%2=0 then 'printed' else 'unknown' end"
            ).alias("human"),
            F.expr(
                "case when n_chars%5=0 then 'unknown' when n_chars%7=0 then 'printed' "
                "when quality=1 then 'student_candidate' else 'printed' end"
            ).alias("predicted"),
            "lang",
            "source",
        )

    def saves(self) -> DataFrame:
        """Every event as one label save; zero-width boxes make invalid saves."""
        box = F.struct(
            _int("cast(floor(value) as int)%900").alias("x"), _int("event_id%700").alias("y"),
            _int("event_id%37").alias("width"), F.lit(20).alias("height"),
        )
        empty = F.col("event_id") % 5 == 0
        return self.table("events").select(
            "event_id",
            "ts",
            F.concat(F.lit("sample_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("sample_id"),
            F.expr(
                "case event_type when 'view' then 'printed' when 'click' then 'student_candidate' "
                "when 'signup' then 'teacher_candidate' else 'unknown' end"
            ).alias("evidence_type"),
            F.when(empty, "verified_empty").otherwise("annotated").alias("answer_status"),
            F.when(empty, F.slice(F.array(box), 1, 0)).otherwise(F.array(box)).alias("boxes"),
            F.lit(True).alias("human_verified"),
        )

    def label_samples(self) -> DataFrame:
        """Samples to be labelled: every user that ever produced an event."""
        return self.table("events").select(
            F.concat(F.lit("sample_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("sample_id")
        ).distinct().withColumn("crop_width", F.lit(1000)).withColumn("crop_height", F.lit(760))
