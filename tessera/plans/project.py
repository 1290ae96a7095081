"""A project of templates derived from the star schema, for the cross-file operators.

Built by concatenation only, so its facts can be restated over the keys in SQL.
Nations render their region, regions render a footer that exists, suppliers
render a brand by ``s_suppkey % 19`` (brand 0 does not exist, the last ones are rendered by
none), and brands up to 5 render the brand 20 above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slug(c):
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, source)``; ids: regions 1000+, nations 2000+, brands 3000+, suppliers 10000+, the footer 1."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, part, supplier = (read(n) for n in ("region", "nation", "part", "supplier"))
    k = F.col("r_regionkey").cast("long")
    regions = region.select(
        (k + 1000).alias("doc_id"), F.concat(F.lit("app/views/regions/_"), slug(F.col("r_name")), F.lit(".html.erb")).alias("path"),
        F.concat(F.lit("<%# locals: (title:, size: 1) %>\n<section><h2><%= title %></h2>"), F.when(k % 2 == 0, "<p><%= size %></p>").otherwise(""), F.lit('<%= render "shared/footer" %></section>\n')).alias("source"),
    )
    n = F.col("n_nationkey").cast("long")
    nations = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        (n + 2000).alias("doc_id"), F.concat(F.lit("app/views/nations/"), n.cast("string"), F.lit(".html.erb")).alias("path"),
        F.concat(
            F.lit('<div class="n"><%= render "regions/'), slug(F.col("r_name")), F.lit('", title: @nation'), F.when(n % 4 == 0, ", colour: 1").otherwise(""), F.lit(" %></div>\n"),
            F.when(n % 5 == 0, '<%= render "shared/#{kind}" %>\n').otherwise(""), F.when(n % 6 == 0, "<%= render @items %>\n").otherwise(""),
        ).alias("source"),
    )
    b = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    brands = part.select("p_brand").distinct().select(
        (b + 3000).alias("doc_id"), F.concat(F.lit("app/views/parts/_"), slug(F.col("p_brand")), F.lit(".html.erb")).alias("path"),
        F.concat(F.lit("<li><%= name %></li>\n"), F.when(b <= 5, F.concat(F.lit('<%= render "brand_'), (b + 20).cast("string"), F.lit('", name: name %>\n'))).otherwise("")).alias("source"),
    )
    s = F.col("s_suppkey")
    suppliers = supplier.select(
        (s + 10000).alias("doc_id"), F.concat(F.lit("app/views/suppliers/"), s.cast("string"), F.lit(".html.erb")).alias("path"),
        F.concat(F.lit("<ul><%= render partial: 'parts/brand_"), (s % 19).cast("string"), F.lit("', locals: { name: @supplier.name } %></ul>\n")).alias("source"),
    )
    footer = spark.createDataFrame([(1, "app/views/shared/_footer.html.erb", "<footer>x</footer>\n"), (2, "app/views/shared/_footer.erb", "<footer>y</footer>\n")], "doc_id long, path string, source string")
    return footer.unionByName(regions).unionByName(nations).unionByName(brands).unionByName(suppliers)
