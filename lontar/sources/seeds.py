"""A small lexicon and sentences of our own, for tests, examples and the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: lemma, class, domain, definition
LEXICON = [
    ("budi", "n", None, "akal; tabiat"), ("beli", "v", "ekonomi", None), ("beras", "n", "kuliner", None),
    ("jual", "v", "ekonomi", None), ("masak", "v", "kuliner", None), ("nasi", "n", "kuliner", None),
    ("sayur", "n", "kuliner", None), ("sayuran", "n", None, "berbagai sayur"), ("meriam", "n", "senjata", None),
    ("senapan", "n", None, "senjata api berlaras panjang"), ("pedang", "n", None, "senjata tajam"),
    ("pasar", "n", "ekonomi", None), ("uang", "n", "ekonomi", None), ("toko", "n", None, "tempat menjual makanan kecil"),
    ("dokter", "n", "kesehatan", None), ("pasien", "n", "kesehatan", None), ("periksa", "v", "kesehatan", None),
    ("obat", "n", "kesehatan", None), ("rawat", "v", "kesehatan", None), ("sakit", "adj", None, "demam, penyakit"),
    ("hakim", "n", "hukum", None), ("hukum", "n", "hukum", None), ("hukuman", "n", "hukum", None), ("vonis", "n", "hukum", None),
    ("terdakwa", "n", "hukum", None), ("jatuh", "v", None, None), ("tangkap", "v", "hukum", None), ("polisi", "n", "hukum", None),
    ("guru", "n", "pendidikan", None), ("siswa", "n", "pendidikan", None), ("ajar", "v", "pendidikan", None),
    ("buku", "n", "pendidikan", None), ("baca", "v", "pendidikan", None), ("sekolah", "n", "pendidikan", None),
    ("mobil", "n", "kendaraan", None), ("rumah", "n", "kuliner", "rumah kaca untuk tanaman"), ("bangun", "v", "bangunan", None),
    ("gitar", "n", "alat_musik", None), ("batu", "n", None, "benda keras dari bumi"), ("anak", "n", None, None),
    ("makan", "v", "kuliner", None), ("makanan", "n", "kuliner", None), ("lezat", "adj", "kuliner", None),
    ("indah", "adj", None, "elok"), ("besar", "adj", None, None), ("tangis", "n", None, None), ("jalan", "n", None, None),
    ("pergi", "v", None, None), ("bersih", "adj", None, None), ("membersihkan", "v", None, None), ("aman", "adj", None, None),
    ("pengamanan", "n", None, None), ("sapu", "n", None, None), ("tulis", "v", "pendidikan", None), ("surat", "n", None, None),
    ("kepada", "p", None, None), ("akibat", "p", None, None), ("kirim", "v", None, None), ("tari", "n", None, None),
    ("saman", "n", None, None), ("orang", "n", None, None), ("tiga", "num", None, None), ("ambil", "v", None, None),
    ("pasar", "v", None, "membuka pasar"), ("obat", "p", None, None), ("indah", "n", "seni", None), ("dalam", "adj", None, None),
    ("tahan", "v", "hukum", None), ("presiden", "n", "hukum", None), ("musik", "n", None, "nada dan lagu"), ("baju", "n", None, "pakaian; busana"),
]

#: document, text, category
SENTENCES = [
    (1, "Budi membeli beras.", "active"), (1, "Dia membeli sayuran di pasar.", "anaphora"), (1, "Orang itu pergi ke pasar.", "anaphora"),
    (2, "Beras dibeli oleh Budi di pasar.", "passive"), (2, "Oleh Budi dibeli beras.", "passive"), (2, "Beras dibeli.", "passive"),
    (3, "Ibu memasak meriam.", "domain"), (3, "Batu menangis.", "domain"), (3, "Makanan itu sangat lezat.", "nominal"),
    (4, "Hakim menjatuhkan hukuman kepada terdakwa.", "active"), (4, "Hakim memberi hukuman kepada vonis.", "domain"), (4, "Polisi menangkap terdakwa.", "active"),
    (5, "Dokter memeriksa pasien di sekolah.", "active"), (5, "Dia merawat anak.", "anaphora"), (5, "Guru tidak mengajar siswa.", "active"),
    (6, "Di beli beras Budi pasar di.", "domain"), (6, "Surat kepada dari terdakwa.", "domain"), (6, "Jenis tarian antara lain saman.", "nominal"),
    (7, "Anak-anak makan nasi.", "active"), (7, "Tari itu indah, antara lain tari saman dan tari besar.", "nominal"), (7, "Meeting itu besar.", "nominal"),
    (8, "Mereka membersihkan rumah; pengamanan sekolah besar.", "active"), (8, "Presiden Budi mengirim surat kepada guru!", "active"), (8, "Café itu menjual naïve beras.", "active"),
    (9, "", "nominal"), (9, "?!...", "nominal"), (9, "Uang hukum sekolah.", "nominal"), (9, "Hukum sekolah uang.", "nominal"),
    (10, "Siswa harus menulis surat dengan buku sejak sekolah.", "active"), (10, "Orang besar mengambil tiga gitar indah.", "active"), (10, "Dia memasak mobil.", "domain"),
    (10, "Itu baju besar.", "nominal"), (10, "Le-lelaki berjalan tanpa uang.", "active"), (10, "Pedang membeli gitar.", "domain"), (10, "Beliau dapat mengajar.", "active"),
]


def lexicon_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c, d, i) for i, (a, b, c, d) in enumerate(LEXICON)], "lemma string, pos string, domain string, definition string, seq int")


def lexicon(spark: SparkSession) -> DataFrame:
    from ..operators.lexicon import build

    return build(lexicon_entries(spark))


def sentences(spark: SparkSession) -> DataFrame:
    """doc_id, sent_idx, text, kategori."""
    n: dict[int, int] = {}
    rows = []
    for d, t, c in SENTENCES:
        rows.append((d, n.get(d, 0), t, c))
        n[d] = n.get(d, 0) + 1
    return spark.createDataFrame(rows, "doc_id long, sent_idx int, text string, kategori string")
