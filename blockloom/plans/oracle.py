"""SQL of the registered queries of the block codec, for any engine with lists and lambdas.

It is made of array expressions, joins, windows and unnested rows, while the queries themselves run in numpy over batches
of blocks: one is checked by the other. A step is a list of 64 by block; each is named and can use those before it.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import tables
from ..functions.dialect import Ansi, Spark
from ..operators import codec

#: (name, expression) steps; each can use the columns before it.
STEPS: dict[str, Callable[[Spark], str]] = {
    "px": codec.pixels,
    "shifted": codec.level_shift,
    "dct": codec.dct,
    "q": codec.quantise,
    "scan_rank": lambda d: codec.permute(d, tables.rank(), "q"),
    "scan_zigzag": lambda d: codec.permute(d, tables.zigzag(), "q"),
    "deq": codec.dequantise,
    "idct": lambda d: codec.dct(d, "deq", inverse=True),
    "rec": codec.restore,
    "fixed": codec.dct_stream,
    "q_fixed": lambda d: codec.quantise_stream(d, "fixed"),
    "fourk": codec.dct_fourk,
    "q_fourk": codec.quantise_fourk,
}
NEEDS = {"px": [], "shifted": ["px"], "dct": ["shifted"], "q": ["dct"], "scan_rank": ["q"], "scan_zigzag": ["q"], "deq": ["q"], "idct": ["deq"], "rec": ["idct"], "fixed": ["shifted"], "q_fixed": ["fixed"], "fourk": ["shifted"], "q_fourk": ["fourk"]}
BASE = ["rid", "vec_id", "label"]
#: Vectors that are blocks: 64 numbers.
FINE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) = 64"
VECTORS = f"s0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings WHERE {FINE})"
#: Documents as images 64 wide, filled with zero bytes to whole rows of blocks: a label is a document, a vec_id a block.
FILLED = "hex(encode(text)) || repeat('00', CAST((512 - octet_length(encode(text)) % 512) % 512 AS INTEGER))"
TILES = f"""whole_texts AS (SELECT doc_id, regexp_extract_all({FILLED}, '..') AS h FROM documents WHERE text IS NOT NULL),
text_bytes AS (SELECT doc_id, unnest(range(0, len(h))) AS k, unnest(h) AS v FROM whole_texts),
tiles AS (SELECT doc_id, k // 512 * 8 + k % 64 // 8 AS block_id, list(CAST('0x' || v AS INT) ORDER BY k) AS px FROM text_bytes GROUP BY ALL)"""
DOCUMENTS = TILES + ", s0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, block_id AS vec_id, doc_id AS label, px FROM tiles)"


def _chain(step: str) -> list[str]:
    out: list[str] = []
    for need in NEEDS[step]:
        out += [x for x in _chain(need) if x not in out]
    return [*out, step]


def _sql(d: Spark, want: list[str], tail: str, source: str = VECTORS) -> str:
    """Common table expressions up to the wanted steps, then the tail over ``blocks``."""
    order: list[str] = []
    for w in want:
        order += [s for s in _chain(w) if s not in order]
    given = "embedding" if source == VECTORS else "px"
    parts, seen, last = [source], [*BASE, given], "s0"
    for k, s in enumerate((s for s in order if s != given), 1):
        parts.append(f"s{k} AS (SELECT {', '.join(seen)}, {STEPS[s](d)} AS {s} FROM {last})")
        seen.append(s)
        last = f"s{k}"
    return f"WITH {', '.join(parts)}, blocks AS (SELECT {', '.join(x for x in seen if x != 'embedding')} FROM {last}), {tail}"


def _long(d: Spark, column: str, more: str = "") -> str:
    """A row for each element of an array column: vec_id, label, pos, v."""
    return f"SELECT rid, vec_id, label{more}, unnest(range(0, 64)) AS pos, unnest({column}) AS v FROM blocks"


def _pairs(d: Spark, column: str = "scan_rank") -> str:
    """Run-length pairs: nonzero coefficients after the first, each with the number of zeros before it."""
    return (
        f"e AS ({_long(d, column)}), nz AS (SELECT * FROM e WHERE pos > 0 AND v <> 0), "
        "pairs AS (SELECT rid, vec_id, label, CAST(row_number() OVER w - 1 AS INT) AS pair_idx, CAST(pos - lag(pos, 1, 0) OVER w - 1 AS INT) AS zero_run, CAST(v AS INT) AS value "
        "FROM nz WINDOW w AS (PARTITION BY rid ORDER BY pos))"
    )


def _array(column: str) -> Callable[[Spark], str]:
    return lambda d: _sql(d, [column], f"e AS ({_long(d, column)}) SELECT vec_id, CAST(pos AS INT) AS pos, CAST(v AS BIGINT) AS v FROM e")


def _pixel_errors(d: Spark) -> str:
    return "e AS (SELECT rid, label, unnest(px) AS o, unnest(rec) AS r FROM blocks)"


SUMS = (
    "count(*) AS pixels, CAST(sum(r - o) AS BIGINT) AS signed_error, CAST(sum(abs(r - o)) AS BIGINT) AS absolute_error, CAST(sum((r - o) * (r - o)) AS BIGINT) AS squared_error, "
    "CAST(sum(o * o) AS BIGINT) AS signal, CAST(max(abs(r - o)) AS INT) AS max_absolute_error, CAST(sum(CASE WHEN r = o THEN 1 ELSE 0 END) AS BIGINT) AS exact_pixels, "
    "CAST(sum(CASE WHEN abs(r - o) <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS within_1, CAST(sum(CASE WHEN abs(r - o) <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS within_2"
)
DERIVED = (
    "round(squared_error / CAST(pixels AS DOUBLE), 6) AS mse, round(sqrt(squared_error / CAST(pixels AS DOUBLE)), 6) AS rmse, round(absolute_error / CAST(pixels AS DOUBLE), 6) AS mae, "
    "round(signed_error / CAST(pixels AS DOUBLE), 6) AS mean_error, max_absolute_error, round(100.0 * exact_pixels / CAST(pixels AS DOUBLE), 6) AS exact_percent, "
    "round(100.0 * within_1 / CAST(pixels AS DOUBLE), 6) AS within_1_percent, round(100.0 * within_2 / CAST(pixels AS DOUBLE), 6) AS within_2_percent"
)
PSNR = "CASE WHEN squared_error = 0 THEN CAST('inf' AS DOUBLE) ELSE round(10 * log10(65025.0 * pixels / CAST(squared_error AS DOUBLE)), 6) END"
SNR = "CASE WHEN squared_error = 0 THEN CAST('inf' AS DOUBLE) WHEN signal = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(10 * log10(signal / CAST(squared_error AS DOUBLE)), 6) END"


def _metrics(tail: str) -> Callable[[Spark], str]:
    return lambda d: _sql(d, ["rec"], f"{_pixel_errors(d)}, sums AS (SELECT label, {SUMS} FROM e GROUP BY label), m AS (SELECT label AS image, pixels, {DERIVED}, {PSNR} AS psnr_db, {SNR} AS snr_db, squared_error FROM sums) {tail}")


def _ssim(d: Spark) -> str:
    return _sql(
        d, ["rec"],
        f"{_pixel_errors(d)}, w AS (SELECT label, rid, avg(o) AS mo, avg(r) AS mr, avg(o * o) - avg(o) * avg(o) AS vo, avg(r * r) - avg(r) * avg(r) AS vr, avg(o * r) - avg(o) * avg(r) AS c FROM e GROUP BY label, rid) "
        "SELECT label AS image, count(*) AS windows, round(avg((2 * mo * mr + 6.5025) * (2 * c + 58.5225) / ((mo * mo + mr * mr + 6.5025) * (vo + vr + 58.5225))), 6) AS mean_ssim_8x8 FROM w GROUP BY label",
    )


def _codes(tail: str, source: str = VECTORS) -> Callable[[Spark], str]:
    """Bits of the packed format, without entropy coding: run-and-size symbols, amplitudes, long runs, end of block."""

    def text(d: Spark) -> str:
        pad = lambda x, n: f"lpad({d.bits(x)}, CAST({n} AS INT), '0')"
        return _sql(
            d, ["scan_zigzag"],
            f"{_pairs(d, 'scan_zigzag')}, sized AS (SELECT *, length({d.bits('CAST(abs(value) AS BIGINT)')}) AS category FROM pairs), "
            "amp AS (SELECT *, CAST(CASE WHEN value >= 0 THEN value ELSE value + power(2, category) - 1 END AS BIGINT) AS amplitude FROM sized), "
            f"code AS (SELECT *, repeat('11110000', CAST(zero_run {d.div} 16 AS INT)) || {pad('CAST((zero_run % 16) * 16 + category AS BIGINT)', 8)} || {pad('amplitude', 'category')} AS bits FROM amp), "
            "per AS (SELECT rid, sum(length(bits)) AS bits, sum(zero_run + 1) AS last FROM code GROUP BY rid), "
            "packed AS (SELECT b.vec_id, b.label, CAST(coalesce(per.bits, 0) + CASE WHEN coalesce(per.last, 0) < 63 THEN 8 ELSE 0 END AS BIGINT) AS bit_count FROM blocks b LEFT JOIN per ON b.rid = per.rid) " + tail, source,
        )

    return text


def _with_pairs(tail: str) -> Callable[[Spark], str]:
    return lambda d: _sql(d, ["scan_rank"], f"{_pairs(d)}, per AS (SELECT b.rid, b.vec_id, b.label, count(p.value) AS n FROM blocks b LEFT JOIN pairs p ON b.rid = p.rid GROUP BY ALL) {tail}")


SIZE = "152 + 3 * count(*) + 3 * CAST(sum(n) AS BIGINT)"
QUERIES: dict[str, Callable[[Spark], str]] = {
    "level_shift": _array("shifted"),
    "dct_cpu_rounded": lambda d: _sql(d, ["dct"], f"e AS ({_long(d, 'dct')}) SELECT vec_id, CAST(pos AS INT) AS pos, CAST(round(v * 1000) AS BIGINT) AS v FROM e"),
    "quantise_cpu": _array("q"),
    "scan_rank": _array("scan_rank"),
    "scan_zigzag": _array("scan_zigzag"),
    "rle_pairs": lambda d: _sql(d, ["scan_rank"], f"{_pairs(d)} SELECT vec_id, pair_idx, zero_run, value FROM pairs"),
    "rle_pair_counts": _with_pairs("SELECT vec_id, n AS pairs FROM per"),
    "rle_decode": lambda d: _sql(d, ["scan_rank"], f"{_pairs(d)} SELECT vec_id, CAST(sum(zero_run + 1) OVER (PARTITION BY rid ORDER BY pair_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS pos, value FROM pairs"),
    "compressed_size_gsc1": _with_pairs(f"SELECT label AS image, {SIZE} AS bytes FROM per GROUP BY label"),
    "compression_ratio": _with_pairs(f", z AS (SELECT label, 64 * count(*) AS raw, {SIZE} AS bytes FROM per GROUP BY label) SELECT label AS image, round(raw / CAST(bytes AS DOUBLE), 6) AS ratio FROM z"),
    "payload_size": _with_pairs("SELECT label AS image, 3 * count(*) + 3 * CAST(sum(n) AS BIGINT) AS bytes FROM per GROUP BY label"),
    "avg_pairs_per_block": _with_pairs("SELECT label AS image, round(avg(n), 6) AS pairs FROM per GROUP BY label"),
    "zero_coeff_pct": lambda d: _sql(d, ["q"], f"e AS ({_long(d, 'q')}) SELECT label AS image, round(100.0 * sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS zero_percent FROM e GROUP BY label"),
    "dequantise": _array("deq"),
    "idct_pixels": _array("rec"),
    "pixel_error_metrics": _metrics("SELECT image, pixels, mse, rmse, mae, mean_error, max_absolute_error, exact_percent, within_1_percent, within_2_percent FROM m"),
    "psnr_snr": _metrics("SELECT image, psnr_db, snr_db FROM m"),
    "psnr_band": _metrics("SELECT image, CASE WHEN psnr_db >= 40 THEN 'very high' WHEN psnr_db >= 30 THEN 'good' WHEN psnr_db >= 25 THEN 'acceptable' ELSE 'degraded' END AS band FROM m"),
    "pooled_metrics": lambda d: _sql(d, ["rec"], f"{_pixel_errors(d)}, sums AS (SELECT {SUMS} FROM e) SELECT pixels, {DERIVED}, {PSNR} AS psnr_db, {SNR} AS snr_db FROM sums"),
    "mean_finite_psnr": _metrics("SELECT coalesce(round(avg(CASE WHEN psnr_db < CAST('inf' AS DOUBLE) THEN psnr_db END), 6), CAST('inf' AS DOUBLE)) AS psnr_db FROM m"),
    "psnr_extremes": _metrics(", r AS (SELECT image, psnr_db, row_number() OVER (ORDER BY psnr_db, image) AS low, row_number() OVER (ORDER BY psnr_db DESC, image) AS high FROM m WHERE psnr_db < CAST('inf' AS DOUBLE)) SELECT image, psnr_db, CASE WHEN low = 1 THEN 'lowest' ELSE 'highest' END AS which FROM r WHERE low = 1 OR high = 1"),
    "aggregate_report_union": _metrics("SELECT CAST(image AS VARCHAR(20)) AS image, pixels, mse, 'ok' AS status FROM m UNION ALL SELECT 'AGGREGATE', CAST(sum(pixels) AS BIGINT), round(sum(squared_error) / CAST(sum(pixels) AS DOUBLE), 6), 'aggregate' FROM m"),
    "missing_reconstruction": _metrics(", o AS (SELECT DISTINCT label AS image FROM embeddings WHERE label IS NOT NULL) SELECT o.image, m.mse, CASE WHEN m.image IS NULL THEN 'error' ELSE 'ok' END AS status FROM o LEFT JOIN m ON o.image = m.image"),
    "ssim_8x8": _ssim,
    "dct_stream_fixed": _array("fixed"),
    "quantise_stream": _array("q_fixed"),
    "cpu_vs_stream_diff": lambda d: _sql(d, ["q", "q_fixed"], "d AS (SELECT vec_id, label FROM blocks WHERE q <> q_fixed) SELECT label AS image, count(*) AS blocks FROM d GROUP BY label"),
    "dct_fourk_fixed": _array("fourk"),
    "quantise_fourk": _array("q_fourk"),
    "cpu_vs_fourk_diff": lambda d: _sql(d, ["q", "q_fourk"], "d AS (SELECT vec_id, label FROM blocks WHERE q <> q_fourk) SELECT label AS image, count(*) AS blocks FROM d GROUP BY label"),
    "magnitude_category": _codes("SELECT vec_id, pair_idx, CAST(category AS INT) AS category FROM sized"),
    "amplitude_code": _codes("SELECT vec_id, pair_idx, amplitude FROM amp"),
    "ac_bit_string": _codes("SELECT vec_id, pair_idx, bits FROM code"),
    "gsc2_size": _codes("SELECT label AS image, 152 + CAST(sum(4 + ceil(bit_count / 8.0)) AS BIGINT) AS bytes FROM packed GROUP BY label"),
}



def _le(x: str, size: int) -> str:
    """Hex of the low bytes of a whole number, lowest first."""
    return " || ".join(f"printf('%02X', CAST((CAST({x} AS BIGINT) >> {8 * k}) & 255 AS INTEGER))" for k in range(size))


_HEAD = "".join(f"{v & 255:02X}{v >> 8:02X}" for v in tables.QUANT)
_TEXT = (
    "text AS (SELECT rid, string_agg(bits, '' ORDER BY pair_idx) AS t, sum(zero_run + 1) AS last FROM code GROUP BY rid), "
    "whole AS (SELECT b.vec_id, b.label, CAST(b.scan_zigzag[1] AS INTEGER) AS dc, coalesce(t, '') || CASE WHEN coalesce(last, 0) < 63 THEN '00000000' ELSE '' END AS t FROM blocks b LEFT JOIN text ON b.rid = text.rid), "
    "bytes AS (SELECT vec_id, label, dc, CAST(length(t) AS INTEGER) AS bit_count, array_to_string(list_transform(range(0, (length(t) + 7) // 8), lambda i: printf('%02X', CAST(list_sum(list_transform([128, 64, 32, 16, 8, 4, 2, 1], "
    "lambda w, j: CASE WHEN substr(t, i * 8 + j, 1) = '1' THEN w ELSE 0 END)) AS INTEGER))), '') AS ac FROM whole)"
)
_ERRORS = f"{_pixel_errors(Ansi())}, sums AS (SELECT label, {SUMS} FROM e GROUP BY label)"
_WINDOWS = (
    "w AS (SELECT label, rid, avg(o) AS mo, avg(r) AS mr, avg(o * o) - avg(o) * avg(o) AS vo, avg(r * r) - avg(r) * avg(r) AS vr, avg(o * r) - avg(o) * avg(r) AS c FROM e GROUP BY label, rid), "
    "alike AS (SELECT label, avg((2 * mo * mr + 6.5025) * (2 * c + 58.5225) / ((mo * mo + mr * mr + 6.5025) * (vo + vr + 58.5225))) AS ssim FROM w GROUP BY label)"
)


def _file(source: str, head: str, blocks: str) -> str:
    """Digest and size of the file of each image, from its blocks in hex."""
    size = "CAST(max(vec_id) // 8 + 1 AS BIGINT) * 8"
    header = f"'{head.encode().hex().upper()}' || {_le('64', 4)} || {_le(size, 4)} || {_le('64', 4)} || {_le(size, 4)} || {_le('count(*)', 4)} || '{_HEAD}'"
    return f"files AS (SELECT label, unhex({header} || string_agg({blocks}, '' ORDER BY vec_id)) AS f FROM {source} GROUP BY label) SELECT label AS doc_id, CAST(octet_length(f) AS BIGINT) AS bytes, sha256(f) AS sha256 FROM files"


def _documents(step: str, scan: str, tail: str) -> str:
    """Pairs of documents' blocks in one of the arithmetics, then the tail over ``per``."""
    d = Ansi()
    STEPS["chosen"], NEEDS["chosen"] = lambda d: codec.permute(d, getattr(tables, scan)(), step), [step]
    per = (
        "per AS (SELECT b.rid, b.vec_id, b.label, CAST(b.chosen[1] AS INTEGER) AS dc, count(p.value) AS n, coalesce(sum(p.zero_run), 0) AS runs, coalesce(sum(p.value * (p.pair_idx + 1)), 0) AS weighted, "
        f"coalesce(string_agg({_le('p.zero_run', 1)} || {_le('p.value', 2)}, '' ORDER BY p.pair_idx), '') AS body FROM blocks b LEFT JOIN pairs p ON b.rid = p.rid GROUP BY ALL)"
    )
    return _sql(d, ["chosen"], f"{_pairs(d, 'chosen')}, {per}, {tail}" if not tail.startswith("SELECT") else f"{_pairs(d, 'chosen')}, {per} {tail}", DOCUMENTS)


def _compared(tail: str) -> str:
    return _sql(Ansi(), ["rec"], f"{_ERRORS}, {_WINDOWS}, c AS (SELECT sums.*, ssim FROM sums JOIN alike USING (label)), {tail}", DOCUMENTS)


def _digits(x: str, n: int = 10) -> str:
    return f"CASE WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END ELSE printf('%.{n}f', {x}) END"


_REPORT = {
    "mse": "squared_error / CAST(pixels AS DOUBLE)", "rmse": "sqrt(squared_error / CAST(pixels AS DOUBLE))", "mae": "absolute_error / CAST(pixels AS DOUBLE)", "mean_error": "signed_error / CAST(pixels AS DOUBLE)",
    "psnr_db": "CASE WHEN squared_error = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(65025.0 * pixels / CAST(squared_error AS DOUBLE)) END",
    "snr_db": "CASE WHEN squared_error = 0 THEN CAST('inf' AS DOUBLE) WHEN signal = 0 THEN CAST('-inf' AS DOUBLE) ELSE 10 * log10(signal / CAST(squared_error AS DOUBLE)) END",
    "mean_ssim_8x8": "ssim", "exact_percent": "100.0 * exact_pixels / CAST(pixels AS DOUBLE)", "within_1_percent": "100.0 * within_1 / CAST(pixels AS DOUBLE)", "within_2_percent": "100.0 * within_2 / CAST(pixels AS DOUBLE)",
}
_POOLED = "SELECT CAST(sum(pixels) AS BIGINT) AS pixels, sum(signed_error) AS signed_error, sum(absolute_error) AS absolute_error, sum(squared_error) AS squared_error, sum(signal) AS signal, max(max_absolute_error) AS max_absolute_error, sum(exact_pixels) AS exact_pixels, sum(within_1) AS within_1, sum(within_2) AS within_2, avg(ssim) AS ssim, count(*) AS images FROM c"


def _report_rows(image: str, size: str, source: str) -> str:
    cells = ", ".join(f"{_digits(x)} AS {n}" for n, x in _REPORT.items())
    return f"SELECT {image} AS image, {size}, CAST(pixels AS VARCHAR) AS pixels, {cells}, CAST(max_absolute_error AS VARCHAR) AS max_absolute_error, CAST(exact_pixels AS VARCHAR) AS exact_pixels, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM {source}"


#: Events as measured times: the stage, image and run of each are made from its number.
def times(stages: list[str]) -> str:
    names = "[" + ", ".join(f"'{s}'" for s in stages) + "]"
    return f"times AS (SELECT 'i' || CAST(user_id AS VARCHAR) AS image, {names}[event_id % {len(stages)} + 1] AS stage, CAST(event_id // {len(stages)} % 3 AS INTEGER) AS run, value AS ms FROM events WHERE user_id IS NOT NULL)"


STREAM_STAGES = ["pgm_load", "host_copy", "h2d", "kernel", "d2h", "file_write"]
KERNELS = ["load_shift", "dct", "quantise", "encode"]
WIDE_STAGES = ["pgm_load", "host_copy", "h2d", *KERNELS, "d2h", "file_write", "end_to_end"]


def _once(stage: str) -> str:
    return f"round(coalesce(sum(CASE WHEN stage = '{stage}' AND run = 0 THEN ms END), 0), 6) AS {stage}_ms"


def _spread(name: str, x: str) -> str:
    return ", ".join(f"round({f}(CASE WHEN run >= 1 THEN {x} END), 6) AS {name}_{n}_ms" for f, n in (("avg", "avg"), ("min", "min"), ("max", "max")))


def _wide() -> str:
    runs = "runs AS (SELECT image, run, " + ", ".join(f"sum(CASE WHEN stage = '{k}' THEN ms END) AS {k}" for k in KERNELS) + ", sum(CASE WHEN stage IN (" + ", ".join(f"'{k}'" for k in KERNELS) + ") THEN ms END) AS total_kernel FROM times GROUP BY ALL)"
    spread = "s AS (SELECT image, count(CASE WHEN run >= 1 THEN total_kernel END) AS timed_runs, " + ", ".join(_spread(k, k) for k in [*KERNELS, "total_kernel"]) + ", avg(CASE WHEN run >= 1 THEN total_kernel END) AS k FROM runs GROUP BY image)"
    once = "o AS (SELECT image, " + ", ".join(_once(x) for x in ["pgm_load", "host_copy", "h2d", "d2h", "file_write", "end_to_end"]) + " FROM times GROUP BY image)"
    return f"WITH {times(WIDE_STAGES)}, {runs}, {spread}, {once} SELECT s.* EXCLUDE (k), o.* EXCLUDE (image), 262144 AS raw_bytes, 65536 AS compressed_bytes, 4.0::DOUBLE AS compression_ratio, 0 AS status, CASE WHEN k > 0 THEN round(0.262144 / (k / 1e3), 6) ELSE 0 END AS kernel_mpix_per_s FROM s JOIN o ON s.image = o.image"


def _stream() -> str:
    runs = "runs AS (SELECT image, run, " + ", ".join(f"sum(CASE WHEN stage = '{x}' THEN ms END) AS {x}" for x in STREAM_STAGES) + " FROM times GROUP BY ALL)"
    raw = {x: f"coalesce(sum(CASE WHEN run = 0 THEN {x} END), 0)" for x in STREAM_STAGES}
    once = ", ".join(f"round({raw[x]}, 6) AS {x}_ms" for x in STREAM_STAGES if x != "kernel")
    k = "avg(CASE WHEN run >= 1 THEN kernel END)"
    path = f"{raw['h2d']} + {k} + {raw['d2h']}"
    return f"WITH {times(STREAM_STAGES)}, {runs} SELECT image, 262144 AS raw_bytes, 65536 AS compressed_bytes, 4.0::DOUBLE AS compression_ratio, count(CASE WHEN run >= 1 THEN kernel END) AS timed_runs, {once}, {_spread('kernel', 'kernel')}, round({path}, 6) AS pipeline_with_transfer_avg_ms, round({raw['pgm_load']} + {raw['host_copy']} + {path} + {raw['file_write']}, 6) AS estimated_end_to_end_avg_ms, CASE WHEN {k} > 0 THEN round(0.262144 / ({k} / 1e3), 6) ELSE 0 END AS kernel_mpix_per_s FROM runs GROUP BY image"


def sql() -> dict[str, str]:
    d = Ansi()
    out = {name: text(d) for name, text in QUERIES.items()}
    out["pack_bits"] = _codes(f", {_TEXT} SELECT vec_id, bit_count, ac FROM bytes")(d)
    out["unpack_bits"] = _sql(d, ["scan_zigzag"], f"{_pairs(d, 'scan_zigzag')} SELECT vec_id, pair_idx, zero_run, value FROM pairs")
    out["decode_pairs"] = out["idct_pixels"]
    out["valid_slots"] = out["rle_pairs"]
    out["fixed_slots"] = _sql(d, ["scan_rank"], f"{_pairs(d)}, s AS (SELECT rid, vec_id, unnest(range(0, 63)) AS slot FROM blocks) SELECT s.vec_id, CAST(s.slot AS INTEGER) AS slot, coalesce(p.zero_run, 0) AS zero_run, coalesce(p.value, 0) AS value FROM s LEFT JOIN pairs p ON s.rid = p.rid AND s.slot = p.pair_idx")
    out["tile_documents"] = f"WITH {TILES} SELECT doc_id, CAST(block_id AS BIGINT) AS block_id, CAST(block_id % 8 AS INTEGER) AS bx, CAST(block_id // 8 AS INTEGER) AS block_row, CAST(list_sum(px) AS BIGINT) AS total, CAST(list_sum(list_transform(px, lambda x, i: x * i)) AS BIGINT) AS weighted FROM tiles"
    shown = "SELECT label AS doc_id, CAST(vec_id AS BIGINT) AS block_id, dc, CAST(n AS INTEGER) AS pairs, CAST(3 + 3 * n AS INTEGER) AS bytes FROM per"
    out["encode_documents_cpu"], out["encode_documents_stream"] = _documents("q", "rank", shown), _documents("q_fixed", "rank", shown)
    out["gsc1_documents"] = _documents("q", "rank", _file("per", "GSC1", f"{_le('dc', 2)} || {_le('n', 1)} || body"))
    out["gsc1_read_documents"] = _documents("q", "rank", "SELECT label AS doc_id, CAST(vec_id AS BIGINT) AS block_id, dc, n AS pairs, CAST(runs AS BIGINT) AS runs, CAST(weighted AS BIGINT) AS weighted FROM per")
    out["compression_summary"] = _documents("q", "rank", "f AS (SELECT label, 64 * count(*) AS raw, 152 + 3 * count(*) + 3 * sum(n) AS packed FROM per GROUP BY label) SELECT count(*) AS images, CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum(packed) AS BIGINT) AS compressed_bytes, round(sum(raw) / CAST(sum(packed) AS DOUBLE), 6) AS compression_ratio FROM f")
    out["gsc2_documents"] = _codes(f", {_TEXT}, " + _file("bytes", "GSC2", f"{_le('dc', 2)} || {_le('bit_count', 2)} || ac"), DOCUMENTS)(d)
    rows = "CAST((octet_length(encode(text)) + 511) // 512 * 8 AS BIGINT)"
    out["pgm_documents"] = f"WITH f AS (SELECT doc_id, unhex(hex(encode('P5' || chr(10) || '64 ' || {rows} || chr(10) || '255' || chr(10))) || {FILLED}) AS f FROM documents WHERE text <> '') SELECT doc_id, CAST(octet_length(f) AS BIGINT) AS bytes, sha256(f) AS sha256 FROM f"
    out["pgm_read_documents"] = f"SELECT doc_id, CAST(64 AS BIGINT) AS width, {rows} AS height, sha256(unhex({FILLED})) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text <> ''"
    image = "CAST(label AS VARCHAR) || '.pgm'"
    out["comparison_report"] = _compared(f"pool AS ({_POOLED}) " + _report_rows(image, "'64' AS width, CAST(pixels // 64 AS VARCHAR) AS height", "c") + " UNION ALL " + _report_rows("'AGGREGATE'", "NULL, NULL", "pool"))
    finite = "isfinite(psnr)"
    out["comparison_summary"] = _compared(
        f"pool AS ({_POOLED}), p AS (SELECT {image} AS image, {_REPORT['psnr_db']} AS psnr FROM c) SELECT images AS images_found, images AS succeeded, 0::BIGINT AS failed, 0 AS exit_code, pixels, "
        + ", ".join(f"round({_REPORT[n]}, 6) AS {n}" for n in ("mse", "rmse", "mae", "mean_error", "psnr_db", "mean_ssim_8x8", "exact_percent", "within_1_percent", "within_2_percent"))
        + f", max_absolute_error, (SELECT coalesce(round(avg(psnr), 6), CAST('inf' AS DOUBLE)) FROM p WHERE {finite}) AS mean_finite_psnr_db, (SELECT image FROM p WHERE {finite} ORDER BY psnr, image LIMIT 1) AS lowest_image, (SELECT round(min(psnr), 6) FROM p WHERE {finite}) AS lowest_psnr_db, (SELECT image FROM p WHERE {finite} ORDER BY psnr DESC, image LIMIT 1) AS highest_image, (SELECT round(max(psnr), 6) FROM p WHERE {finite}) AS highest_psnr_db FROM pool"
    )
    out["sample_stats"] = f"WITH {times(STREAM_STAGES)} SELECT image, stage, count(*) AS runs, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM times WHERE run >= 1 GROUP BY image, stage"
    out["throughput"] = f"WITH {times(STREAM_STAGES)}, t AS (SELECT image, sum(ms) AS ms FROM times GROUP BY image) SELECT count(*) AS images, CAST(count(*) * 262144 AS BIGINT) AS pixels, round(count(*) * 262144 / 1e6 / (sum(ms) / 1e3), 6) AS megapixels_per_s, round(count(*) / (sum(ms) / 1e3), 6) AS images_per_s FROM t"
    out["stage_profile"] = (
        f"WITH {times(STREAM_STAGES)}, a AS (SELECT count(DISTINCT image) AS images, 4096 * count(DISTINCT image) AS blocks, 1.25 * sum(ms) AS all_ms, sum(ms) AS used FROM times), s AS (SELECT stage, sum(ms) AS total_ms FROM times GROUP BY stage UNION ALL SELECT 'other', greatest(0, all_ms - used) FROM a) "
        "SELECT stage, round(total_ms, 4) AS total_ms, round(total_ms / images, 4) AS ms_per_image, round(100 * total_ms / all_ms, 4) AS percent, round(1000 * total_ms / blocks, 4) AS us_per_block FROM s, a"
    )
    out["stream_profile"], out["hardware_profile"] = _stream(), _wide()
    return out
