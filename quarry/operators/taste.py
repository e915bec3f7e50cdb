"""What rule texts say a wine must look, smell and taste like: clauses by style, in French, Italian and Spanish.

Each line of a text is a row with marks (key line, heading, blank, page furniture, ...); windows over the lines of one document
find the section, join wrapped lines and tell blocks apart, and groups make the clauses. Result of all three: doc, place,
style, style_key, colour, clause, min_alcohol, sweetness. Null and empty texts and texts without the section give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: Characters of a clause, and bounds of an alcohol figure (fixed values).
LONGEST, ALCOHOL = 2500, (5, 25)

# Words and patterns of the three languages (fixed values).
COLOURS = {
    "fr": [
        ("sparkling", r"\b(mousseux|p[ée]tillants?|cr[ée]mant|effervescents?)\b"),
        ("sweet", r"\b(vins? doux naturels?|vdn|liquoreux|moelleux|vendanges tardives|s[ée]lection de grains nobles|vin de paille|rancio)\b"),
        ("rose", r"\b(ros[ée]s?|gris)\b"), ("white", r"\b(blancs?|jaune)\b"), ("red", r"\b(rouges?)\b"),
    ],
    "it": [
        ("sparkling", r"\b(spumante|frizzante|metodo classico)\b"),
        ("sweet", r"\b(passito|dolce|vendemmia tardiva|recioto|vin santo|vino santo|liquoroso)\b"),
        ("rose", r"\b(rosato|ros[eé]|chiaretto|cerasuolo|kretzer)\b"), ("white", r"\b(bianco|bianca)\b"), ("red", r"\b(rosso|rossa|nero|novello)\b"),
    ],
    "es": [
        ("sparkling", r"\b(espumosos?|cava|aguja)\b"),
        ("fortified", r"\b(generosos?|licorosos?|fino|manzanilla|amontillado|oloroso|palo cortado|rancio|fondill[óo]n|mistela)\b"),
        ("sweet", r"\b(dulces?|naturalmente dulce|vendimia tard[íi]a|moscatel)\b"),
        ("rose", r"\b(rosados?|claretes?)\b"), ("white", r"\b(blancos?)\b"), ("red", r"\b(tintos?)\b"),
    ],
}
SHADES = {
    "fr": [
        ("rose", r"\b(robe|couleur|teinte)\b[^.]{0,40}\b(rose|ros[ée]e?|saumon|[ée]glantine|pelure d'oignon)\b"),
        ("white", r"\b(robe|couleur|teinte)\b[^.]{0,40}\b(or|dor[ée]e?|jaune|paille|citron|verts?|p[âa]le)\b"),
        ("red", r"\b(robe|couleur|teinte)\b[^.]{0,40}\b(rouge|rubis|grenat|pourpre|violac[ée]e?|noire?|sombre|profonde|intense)\b"),
    ],
    "it": [("rose", r"\b(rosa|rosato|cerasuolo|chiaretto|ramato)\b"), ("white", r"\b(giallo|paglierino|dorato|verdolino|ambrato|oro)\b"), ("red", r"\b(rosso|rubino|granato|porpora|violaceo|aranciato)\b")],
    "es": [
        ("rose", r"\b(rosa|rosado|ros[áa]ceo|salm[óo]n|piel de cebolla)\b"), ("white", r"\b(amarillo|pajizo|dorado|oro|verdoso|verde lim[óo]n|p[áa]lido)\b"),
        ("red", r"\b(rojo|p[úu]rpura|cereza|picota|granate|rub[íi]|viol[áa]ceo|teja)\b"),
    ],
}
SWEETNESS = {
    "fr": [
        ("sweet", r"\bvins?\s+(?:\w+\s+)?(liquoreux|doux naturels?|moelleux)\b|\bsont (?:des vins )?(liquoreux|moelleux|doux)\b"), ("off-dry", r"\bvins?\s+demi-secs?\b"),
        ("dry", r"\bvins?\s+(?:\w+\s+)?secs?\b|\bvin blanc sec\b|\bsont secs\b|\bsont des vins secs\b"),
    ],
    "it": [
        ("dry", r"\bsecco\b|\basciutto\b"), ("off-dry", r"\babboccato\b"), ("medium-sweet", r"\bamabile\b"), ("sweet", r"\bdolce\b"),
        ("brut nature", r"\bpas dos[ée]\b|\bdosaggio zero\b|\bbrut nature\b"), ("extra brut", r"\bextra brut\b"), ("brut", r"\bbrut\b"), ("extra dry", r"\bextra ?dry\b"),
        ("dry (sparkling)", r"\bdry\b"), ("demi-sec", r"\bdemi[- ]sec\b"),
    ],
    "es": [("medium-sweet", r"\bsemi ?dulce\b"), ("off-dry", r"\bsemi ?seco\b"), ("sweet", r"\bdulces?\b"), ("dry", r"(?<!frutos? )(?<!frutas )\bsecos?\b")],
}
FR_NOISE = r"^\s*(proc[ée]dure nationale d[’']opposition|(aux|relatives aux) vins et aux boissons alcoolis[ée]es|modifications? du cahier des charges|cahier des charges de l[’']appellation|version n°|(g[ée]ographiques prot[ée]g[ée]es|relatives aux vins et aux cidres|d[’']origine relatives)|et des boissons spiritueuses|(pr[ée]sent[ée]e|approuv[ée]e|adopt[ée]e)s? (au|par le) comit[ée] national)|^\s*\d{1,3}\s*(/\s*\d{1,3})?\s*$"
FR_STARTS = [r"informations? sur (?:la qualit[ée] et )?les caract[ée]ristiques d[ue]s? (?:produits?|vins)", r"sp[ée]cificit[ée] du produit"]
FR_END = r"interactions? causales?|lien causal|lien entre la sp[ée]cificit[ée]|sp[ée]cificit[ée] de la zone g[ée]ographique|3°\s*-"
FR_HEADING = r"^\s{4,}((?i:vins?\s[^.:]{2,50})|[A-ZÉ][^.:]{2,40})\s*$"
FR_OPEN = r"^(?:les|le|la)\s+vins?\s+((?:(?:blancs?|rouges?|ros[ée]s?|gris|mousseux|p[ée]tillants?|tranquilles?|liquoreux|moelleux|secs?|doux|jaune|de paille|effervescents?|de qualit[ée]|naturels?)\b\s*){1,4})"
FR_TASTE = r"\b(robe|ar[ôo]mes?|aromatique|bouche|tanins?|tanniques?|frais|fra[îi]cheur|fruit[ée]s?|floraux?|floral|min[ée]ral|notes?|nez|finale|souples?|ronds?|rondeur|vifs?|vivacit[ée]|puissants?|charpent[ée]s?|[ée]l[ée]gants?|finesse|complexes?|complexit[ée]|persistan|structure|gras|onctu|sucr|moelleux|liquoreux|secs?|douceur|acidit[ée]|couleur|teinte|reflets|bouquet|saveur|mousse|bulles?|garde)\b"
FR_ALCOHOL = r"titre alcoom[ée]trique volumique naturel minimum\s+(?:de|est fix[ée] [àa])\s+(\d{1,2}(?:[.,]\d)?)\s*%(?:\s+(?:pour les|les)\s+vins\s+(blancs|rouges|ros[ée]s))?"
IT_KEY = r"^\s*(?:[-–•]\s*){0,2}(spuma|colore|odore|profumo|sapore|gusto|titolo alcolometrico[^:]*|acidit[àa] totale[^:]*|estratto[^:]*|zuccher[^:]*|acidit[àa] volatile[^:]*|anidride carbonica[^:]*|sovrappressione[^:]*|pressione[^:]*|residuo zuccherino[^:]*)\s*:"
IT_INTRO = r"\b(?:il vino|i vini|la tipologia|le tipologie|la denominazione)\b.*?\b(?:deve|devono)\s+(?:rispondere|presentare|avere)\b.*?caratteristiche\s*[:;.]?\s*$"
IT_BREAK = r"^\s*(articolo|art\.)\s*\d+|^\s*\d+[.)]\s+\S|^\s*\d{1,3}\s*$"
IT_LABEL_GONE = [
    r"^\s*(\d+[.)]|[a-z][.)]|[-–•])\s*", r"\b(il|i)\s+vin[oi]\s+(a|ad)\s+denominazione\s+di\s+origine\s+controllata(\s+e\s+garantita)?\b", r"\b(il|i)\s+vin[oi]\s+a\s+d\.?o\.?c\.?g?\.?\b",
    r"\b(il|i)\s+vin[oi]\s+(a|ad)\s+indicazione\s+geografica\s+(tipica|protetta)\b", r"\ball[’']atto\s+dell[’']immissione\s+al\s+consumo\b", r"\b(deve|devono)\s+(rispondere|presentare|avere)\b.*$",
    r"\b(designat[oi]|con la (?:menzione|specificazione|indicazione)|tipologia|nella tipologia|nelle tipologie|con (?:le|la|i|il) (?:riferiment[oi]|menzion[ei]|specificazion[ei]))\b", r"[«»“”\"']",
]
IT_NO_LABEL = r"\b(ufficio|ministero|disciplinare|pqa|dgpqa|gazzetta|decreto)\b"
IT_ALCOHOL = r"titolo alcolometrico volumico[^:\n]*minimo[^:\n]*:\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*%"
ES_SECTION = r"organol[ée]ptic"
ES_NUMBER = r"^(?:\(?[a-z\d]{1,3}[.)]\s*)+"
ES_END = r"^(pr[áa]cticas\s+(enol[óo]gicas|de cultivo|vit[íi]colas|espec[íi]ficas)|delimitaci[óo]n|zona geogr[áa]fica|rendimiento|variedades?\s+de\s+(uva|vid)|v[íi]nculo|elementos que justifican|estructura de control|requisitos aplicables|etiquetado|normas? de etiquetado|caracter[íi]sticas anal[íi]ticas|par[áa]metros anal[íi]ticos)"
ES_TYPES = r"\b(VINOS?|TINTOS?|BLANCOS?|ROSADOS?|CLARETES?|ESPUMOSOS?|LICOR|DULCES?|CRIANZA|RESERVA|J[ÓO]VEN(ES)?|GENEROSOS?|RANCIOS?|AGUJA|FASE|ASPECTO|VISTA|OLFATO|BOCA)\b"
ES_KEY = r"^\s*(?:[-–•·]\s*){0,2}(?:\(?[\d.]{1,7}\)?\s+|[a-z][.)]\s+)?(vista|fase visual|aspecto visual|visual|olfato|nariz|fase olfativa|aspecto olfativo|olfativa|olfativo|boca|gusto|fase gustativa|aspecto gustativo|gustativa|gustativo)\b\s*[:.]?"
ES_NOISE = r"^\s*\d{1,3}\s*$|^\s*p[áa](x|g)ina\s+\d+|^\s*pliego de condiciones"
ES_OPEN = r"^(?:los|el|las|la)\s+(vinos?\s+(?:[\w\- ]{0,30}?)(?:tintos?|blancos?|rosados?|claretes?|espumosos?|dulces?|generosos?|licorosos?|de licor|de aguja|j[óo]venes)\b)"
ES_TASTE = r"\b(color|aroma|olor|sabor|burbuja|frescura|arom[áa]tic|boca|nariz|tanin|fresc|frut|flor|equilibr|estructur|persisten|untuos|[áa]cid|amargo|dulz|limpio|brillante|capa|ribete|tonos?|notas?|recuerdos?|especi|madera|crianza)"
ES_ALCOHOL = r"grado alcoh[óo]lico[^\n]{0,60}m[íi]nimo[^\n]{0,20}?(\d{1,2}(?:[.,]\d)?)\s*%?\s*vol"


def _has(c: Column, pattern: str) -> Column:
    return c.rlike("(?iu)" + pattern)


def _squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\f]+", " "))


def _first(c: Column, words: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(_has(c, p), kind) for kind, p in words])


def _figure(c: Column) -> Column:
    n = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(n.between(*ALCOHOL), n)


def _key(style: Column) -> Column:
    return F.coalesce(F.nullif(T.name_key(style), F.lit("")), F.lit("all"))


def _colour(lang: str, label: Column, clause: Column) -> Column:
    head = F.substring(clause, 1, 200)
    return F.coalesce(_first(label, COLOURS[lang]), _first(head, COLOURS[lang]), _first(head, SHADES[lang]))


def _lines(texts: DataFrame) -> DataFrame:
    """doc, n, line: the lines with plain blanks, and hyphens for the bullets of symbol fonts."""
    plain = F.regexp_replace(F.regexp_replace("text", r"[\u00A0\u2007\u202F]", " "), r"[\uE000-\uF8FF]", "-")
    return texts.select("doc", F.posexplode(F.split(plain, "\n")).alias("n", "line"))


def _over(*keys: str) -> tuple[Window, Window]:
    """All lines up to the current one, and those before it."""
    w = Window.partitionBy("doc", *keys).orderBy("n")
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def _gathered(rows: DataFrame, keys: list[str], value: Column, sep: str) -> DataFrame:
    """The value of a group's rows in order of n, joined; n is the group's first."""
    listed = F.array_sort(F.collect_list(F.struct("n", value.alias("v"))))
    return rows.groupBy("doc", *keys).agg(F.min("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias("clause"))


def _finished(rows: DataFrame) -> DataFrame:
    """rows(doc, n, style, colour, clause, min_alcohol, sweetness): repeats go, further texts of one style get numbers."""
    rows = rows.withColumn("style_key", _key(F.col("style"))).withColumn("clause", F.substring("clause", 1, LONGEST))
    w = Window.partitionBy("doc", "style_key", "clause").orderBy("n")
    rows = rows.withColumn("_again", F.row_number().over(w)).filter("_again = 1").drop("_again")
    nth = F.row_number().over(Window.partitionBy("doc", "style_key").orderBy("n"))
    key = F.when(nth > 1, F.concat_ws(" ", "style_key", nth.cast("string"))).otherwise(F.col("style_key"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("n"))
    return rows.select("doc", place.alias("place"), "style", key.alias("style_key"), "colour", "clause", "min_alcohol", "sweetness")


def _styled(paragraphs: DataFrame, least: int) -> DataFrame:
    """paragraphs(doc, n, style, clause) gathered to clauses: one opens where its style differs from the last that was named."""
    upto, before = _over()
    key = F.when(F.col("style").isNotNull(), _key(F.col("style")))
    p = paragraphs.withColumn("key", key)
    opens = F.row_number().over(Window.partitionBy("doc").orderBy("n")) == 1
    opens = opens | (F.col("key") != F.coalesce(F.last("key", ignorenulls=True).over(before), F.lit("all")))
    p = p.withColumn("part", F.sum(F.when(opens, 1).otherwise(0)).over(upto))
    styles = p.groupBy("doc", "part").agg(F.min_by("style", "n").alias("style"))
    return _gathered(p, ["part"], F.col("clause"), "\n").join(styles, ["doc", "part"]).filter(F.length("clause") >= least)


def french(texts: DataFrame) -> DataFrame:
    """texts(doc, text): the clauses of a specification's section on the product's quality and character.

    Paragraphs lie between blank lines, without page furniture. A style opens at "Les vins blancs ..." or under a centred
    heading; paragraphs that are neither long nor about taste are left out. Alcohol comes from the whole text, where it
    states one figure, or one for the colour.
    """
    lines = _lines(texts)
    upto, before = _over()
    whole = Window.partitionBy("doc")
    starts = F.coalesce(*[F.min(F.when(_has(F.col("line"), p) & (F.col("n") > 0), F.col("n"))).over(whole) for p in FR_STARTS])
    body = lines.withColumn("start", starts).filter(F.col("n") > F.col("start"))
    ended = F.max(_has(F.col("line"), FR_END)).over(upto)
    size = F.sum(F.length("line") + 1).over(upto)
    body = body.withColumn("ended", ended).withColumn("size", size).withColumn("closed", F.max("ended").over(whole))
    body = body.filter(~F.col("ended") & (F.col("closed") | (F.col("size") <= 12_000)))
    body = body.withColumn("all", F.max("size").over(whole)).filter("all <= 20000").filter(~_has(F.col("line"), FR_NOISE))
    body = body.withColumn("line", F.regexp_replace("line", "\f", "")).withColumn("blank", F.trim("line") == "")
    body = body.withColumn("run", F.sum(F.when(F.col("blank"), 1).otherwise(0)).over(upto)).filter("NOT blank")
    # headings stand at the beginning of a run of lines
    own, _ = _over("run")
    body = body.withColumn("heads", F.min(F.col("line").rlike(FR_HEADING)).over(own))
    body = body.withColumn("heading", F.last(F.when(F.col("heads"), _squash(F.col("line"))), ignorenulls=True).over(upto))
    paras = _gathered(body.filter("NOT heads"), ["run", "heading"], F.trim("line"), " ").withColumn("clause", _squash(F.col("clause")))
    paras = paras.filter(_has(F.col("clause"), FR_TASTE) | (F.length("clause") >= 400))
    open_ = F.nullif(_squash(F.regexp_extract("clause", "(?iu)" + FR_OPEN, 1)), F.lit(""))
    out = _styled(paras.withColumn("style", F.coalesce("heading", F.concat(F.lit("vins "), open_))), 40)
    out = out.withColumn("colour", _colour("fr", F.col("style"), F.col("clause")))

    flat = F.regexp_replace("text", r"\s+", " ")
    found = F.regexp_extract_all(flat, F.lit("(?iu)" + FR_ALCOHOL), F.lit(0))
    each = texts.select("doc", F.explode(found).alias("m")).select("doc", _figure(F.regexp_extract("m", "(?iu)" + FR_ALCOHOL, 1)).alias("v"), _first(F.nullif(F.regexp_extract("m", "(?iu)" + FR_ALCOHOL, 2), F.lit("")), COLOURS["fr"]).alias("of"))
    each = each.filter("v IS NOT NULL").groupBy("doc", "of").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    alone = each.groupBy("doc").agg(F.count("*").alias("kinds"), F.max(F.when(F.col("of").isNull() & (F.col("low") == F.col("high")), F.col("low"))).alias("only"))
    out = out.join(each.select("doc", F.col("of").alias("colour"), F.col("low").alias("own")), ["doc", "colour"], "left").join(alone, "doc", "left")
    head = F.substring("clause", 1, 300)
    sweet = F.coalesce(_first(head, SWEETNESS["fr"][:2]), _first(F.col("clause"), SWEETNESS["fr"][2:]))
    return _finished(out.withColumn("min_alcohol", F.coalesce("own", F.when(F.col("kinds") == 1, F.col("only")))).withColumn("sweetness", sweet))


def italian(texts: DataFrame) -> DataFrame:
    """texts(doc, text): one clause for each block of lines colore, odore, sapore, titolo ..., with wrapped lines joined.

    A block begins at a colour line (or a foam line up to three lines before one) and goes on over key lines, the lines that
    continue one without a full stop, and blanks before a further key line. Its style is the sentence that introduces it, or
    else the short heading above.
    """
    rows = _lines(texts).withColumn("line", F.regexp_replace("line", "\f", ""))
    by = Window.partitionBy("doc").orderBy("n")
    upto, before = _over()
    kind = F.lower(F.regexp_extract("line", "(?iu)" + IT_KEY, 1))
    rows = rows.withColumn("kind", kind).withColumn("blank", F.trim("line") == "")
    colours = [F.lead("kind", i).over(by) == "colore" for i in (1, 2, 3)]
    starts = (F.col("kind") == "colore") | ((F.col("kind") == "spuma") & F.coalesce(F.greatest(*[c.cast("int") for c in colours]), F.lit(0)).cast("boolean"))
    follow = F.coalesce(*[F.when(~F.lead("blank", i).over(by), F.lead("kind", i).over(by)) for i in (1, 2)])
    said = F.last(F.when(~F.col("blank"), F.col("line")), ignorenulls=True).over(before)
    on = F.when(F.col("kind") != "", True).when(F.col("blank"), ~F.coalesce(follow, F.lit("")).isin("", "colore", "spuma"))
    on = on.otherwise(~_has(F.col("line"), IT_BREAK) & ~F.coalesce(said.rlike(r"[;.]\s*$"), F.lit(True)))
    rows = rows.withColumn("starts", starts).withColumn("on", on)
    rows = rows.withColumn("part", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(upto))
    within, earlier = _over("part")
    rows = rows.withColumn("inside", F.col("on") & F.max("starts").over(within)).withColumn("first", F.col("inside") & ~F.coalesce(F.max("starts").over(earlier), F.lit(False)))
    # the lines between the block before and this one, twelve at most
    recent = F.collect_list(F.struct("line", "inside", "blank")).over(by.rowsBetween(-12, -1))
    rows = rows.withColumn("recent", F.when(F.col("first"), recent))
    parts = rows.filter("inside AND NOT blank").withColumn("piece", F.concat(F.when(F.col("kind") != "", F.lit("\n")).otherwise(F.lit(" ")), _squash(F.col("line"))))
    blocks = _gathered(parts, ["part"], F.col("piece"), "").withColumn("clause", F.substring("clause", F.lit(2), F.length("clause")))
    gap = F.aggregate("recent", F.array().cast("array<string>"), lambda a, x: F.when(x["inside"], F.array().cast("array<string>")).otherwise(F.when(x["blank"] | x["line"].rlike(r"^\s*\d{1,3}\s*$"), a).otherwise(F.concat(a, F.array(x["line"])))))
    heads = rows.filter("first").select("doc", "part", gap.alias("gap"))
    flat = _squash(F.array_join("gap", " "))
    intro = F.nullif(F.regexp_extract(flat, "(?iu)" + IT_INTRO, 0), F.lit(""))
    above = F.trim(F.try_element_at("gap", F.lit(-1)))
    above = F.when((F.length(above) <= 70) & ~above.rlike(r"[.;]$"), above)
    label = reduce(lambda c, p: F.regexp_replace(c, "(?iu)" + p, " "), IT_LABEL_GONE, F.coalesce(intro, above))
    label = F.regexp_replace(F.regexp_replace(_squash(label), r"\s+,", ","), r",\s*(?=,)|^[\s,:;.]+|[\s,:;.]+$", "")
    heads = heads.select("doc", "part", label.alias("label"))
    style = F.when((F.col("label") != "") & ~_has(F.col("label"), IT_NO_LABEL), F.substring("label", 1, 90))
    out = blocks.join(heads, ["doc", "part"]).withColumn("style", style)
    colour_line = F.regexp_extract("clause", r"(?iu)colore\s*:\s*([^\n]*)", 1)
    taste = F.regexp_extract("clause", r"(?iu)(?:sapore|gusto)\s*:\s*([^\n]*)", 1)
    span = r"(?iu)\bda\s+([a-z ]+?)\s+(?:a|ad|al|all[’'])\s+([a-z\- ]+?)(?:[,;.]|$)"
    ends = [_first(F.regexp_extract(taste, span, i), SWEETNESS["it"]) for i in (1, 2)]
    sweet = F.coalesce(F.concat(ends[0], F.lit(" to "), ends[1]), _first(taste, SWEETNESS["it"]))
    out = out.withColumn("colour", _colour("it", F.col("style"), colour_line))
    return _finished(out.withColumn("min_alcohol", _figure(F.regexp_extract("clause", "(?iu)" + IT_ALCOHOL, 1))).withColumn("sweetness", sweet))


def spanish(texts: DataFrame) -> DataFrame:
    """texts(doc, text): the clauses of a specification's organoleptic section.

    Blocks of sight, nose and mouth lines, with wrapped lines joined; a block ends where a label stands or one of the three
    comes again, and takes the label above. Text under a label without such lines is a clause of prose. Where there is no
    block at all, paragraphs are gathered by style, which opens at "Los vinos tintos ...".
    """
    rows = _lines(texts).withColumn("line", F.regexp_replace("line", "\f", "")).withColumn("t", F.trim("line"))
    by = Window.partitionBy("doc").orderBy("n")
    whole = Window.partitionBy("doc")
    upto, before = _over()
    upper = (F.col("t") == F.upper("t")) & F.col("t").rlike("[A-ZÁÉÍÓÚÑ]{3}")
    words = F.size(F.split("t", r"\s+"))
    names = _has(F.col("t"), ES_SECTION)
    heads = names & (F.length("t") <= 90) & (words <= 10) & (_has(F.col("t"), ES_NUMBER) | upper | F.col("t").rlike("^[A-ZÁÉÍÓÚÑ]"))
    start = F.coalesce(F.min(F.when(heads, F.col("n"))).over(whole), F.min(F.when(names, F.col("n"))).over(whole))
    family = F.lower(F.regexp_extract("line", "(?iu)" + ES_KEY, 1))
    rows = rows.withColumn("start", start).withColumn("said", family).filter((F.col("n") > F.col("start")) & (F.col("n") < F.col("start") + 400))
    bare = F.regexp_replace("t", r"^(?:\(?(?:\d+(?:\.\s?\d+)*|[a-zA-Z]|[ivxIVX]{1,4})(?:[.)\-–]+\s*|\s+))+", "")
    rows = rows.withColumn("bare", bare).withColumn("numbered", F.col("t") != F.col("bare"))
    capitals = (F.col("bare") == F.upper("bare")) & F.col("bare").rlike("[A-ZÁÉÍÓÚÑ]{3}")
    over = (F.col("t") != "") & (F.length("t") <= 90) & (F.col("said") == "") & (_has(F.col("bare"), ES_END) | (F.col("numbered") & capitals & (F.length("bare") >= 8) & (F.size(F.split("bare", r"\s+")) >= 2) & ~F.col("bare").rlike(ES_TYPES)))
    rows = rows.withColumn("over", F.max(over).over(upto)).filter("NOT over").filter(~_has(F.col("line"), ES_NOISE))
    follow = F.coalesce(*[F.when(F.lead("t", i).over(by) != "", F.lead("said", i).over(by)) for i in (1, 2, 3)])
    label = (F.col("said") == "") & F.length("bare").between(1, 100) & F.col("bare").rlike("^[«\"“]?[A-ZÁÉÍÓÚÑ]") & ~F.col("bare").rlike(r"[,;]\s*$")
    label = label & (capitals | ((F.length("bare") <= 60) & (F.col("bare").rlike(r":\s*$") | (F.coalesce(follow, F.lit("")) != "") | (F.col("numbered") & (F.length("bare") <= 40)))))
    rows = rows.withColumn("label", label)
    paragraphs = rows
    rows = rows.filter("t <> ''").withColumn("part", F.sum(F.when(F.col("label"), 1).otherwise(0)).over(upto))
    own, earlier = _over("part")
    # a label of two lines goes on in small letters
    wrapped = ~F.col("label") & (F.col("said") == "") & F.coalesce(F.lag("label").over(by), F.lit(False)) & F.col("t").rlike("^[a-záéíóúñ(]") & (F.length("t") <= 60)
    rows = rows.withColumn("title", F.col("label") | wrapped)
    titles = _gathered(rows.filter("title"), ["part"], F.regexp_replace("bare", r"[:.]\s*$", ""), " ").select("doc", "part", F.col("clause").alias("style"))
    body = rows.filter("NOT title").withColumn("sense", F.when(F.col("said").rlike("vis"), "v").when(F.col("said").rlike("olf|nariz"), "o").when(F.col("said") != "", "g"))
    body = body.withColumn("keyed", F.max(F.col("sense").isNotNull()).over(Window.partitionBy("doc", "part")))
    # a sense that the block already has opens the next one
    state = "struct<block:int,seen:array<string>,made:array<struct<n:int,block:int>>>"
    again = lambda a, x: F.array_contains(a["seen"], x["sense"])
    block = lambda a, x: a["block"] + F.when(again(a, x), 1).otherwise(0)
    step = lambda a, x: F.struct(block(a, x).alias("block"), F.concat(F.when(again(a, x), F.array().cast("array<string>")).otherwise(a["seen"]), F.array(x["sense"])).alias("seen"), F.concat(a["made"], F.array(F.struct(x["n"].alias("n"), block(a, x).alias("block")))).alias("made")).cast(state)
    begin = F.struct(F.lit(1).alias("block"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<n:int,block:int>>").alias("made")).cast(state)
    senses = body.filter("sense IS NOT NULL").groupBy("doc", "part").agg(F.array_sort(F.collect_list(F.struct("n", "sense"))).alias("s"))
    dealt = senses.select("doc", "part", F.explode(F.aggregate("s", begin, step, lambda a: a["made"])).alias("x")).select("doc", "part", "x.n", "x.block")
    # text before the first key line is no part of the block
    body = body.join(dealt, ["doc", "part", "n"], "left").withColumn("block", F.coalesce(F.last("block", ignorenulls=True).over(own), F.lit(0))).filter("NOT keyed OR block > 0")
    piece = F.concat(F.when(F.col("sense").isNotNull(), F.lit("\n")).otherwise(F.lit(" ")), _squash(F.col("t")))
    made = _gathered(body.withColumn("piece", piece), ["part", "block", "keyed"], F.col("piece"), "").withColumn("clause", F.substring("clause", F.lit(2), F.length("clause")))
    made = made.join(titles, ["doc", "part"], "left").withColumn("style", F.when(F.col("block") <= 1, F.substring(_squash(F.col("style")), 1, 90)))
    good = F.when(F.col("keyed"), F.col("clause").contains("\n")).otherwise(F.col("style").isNotNull() & _has(F.col("clause"), ES_TASTE) & (F.length("clause") >= 40))
    blocks = made.filter(good).select("doc", "n", "style", "clause")

    runs = paragraphs.join(blocks.select("doc").distinct(), "doc", "left_anti")
    runs = runs.withColumn("run", F.sum(F.when(F.col("t") == "", 1).otherwise(0)).over(upto)).filter("t <> ''")
    paras = _gathered(runs, ["run"], F.col("t"), " ").withColumn("clause", _squash(F.col("clause"))).filter(_has(F.col("clause"), ES_TASTE) | (F.length("clause") >= 400))
    prose = _styled(paras.withColumn("style", F.nullif(_squash(F.regexp_extract("clause", "(?iu)" + ES_OPEN, 1)), F.lit(""))), 40)
    out = blocks.unionByName(prose.select("doc", "n", "style", "clause"))
    out = out.withColumn("colour", _colour("es", F.col("style"), F.col("clause"))).withColumn("min_alcohol", _figure(F.regexp_extract("clause", "(?iu)" + ES_ALCOHOL, 1)))
    return _finished(out.withColumn("sweetness", _first(F.concat_ws(" ", "style", F.substring("clause", 1, 200)), SWEETNESS["es"])))


def clauses(texts: DataFrame) -> DataFrame:
    """texts(doc, lang, text) in fr, it and es -> lang and the clauses of each; other languages have none."""
    each = {"fr": french, "it": italian, "es": spanish}
    return reduce(DataFrame.unionByName, [f(texts.filter(F.col("lang") == lang).select("doc", "text")).withColumn("lang", F.lit(lang)) for lang, f in each.items()])
