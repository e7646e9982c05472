"""Linguistic rule tables of Indonesian: fixed values that results depend on, in their natural order."""

from __future__ import annotations

# Word classes: N V Adj Adv Pron Num Prep Konj Interj Art Part N_proper N_serapan V_serapan ?
# Roles: S P O K Pel Mod Det ?

# ---- closed classes, looked up in this order -------------------------------------------------------------------
PREPOSITIONS = """di ke dari pada dalam antara atas bawah depan belakang samping untuk bagi demi sejak hingga sampai
oleh dengan tanpa tentang mengenai terhadap melalui melintasi sepanjang sekitar""".split()
CONJUNCTIONS = """dan atau tetapi namun melainkan sedangkan sementara meskipun walaupun karena sebab sehingga agar
supaya jika kalau bila bahwa yang saat ketika setelah sebelum selama""".split()
PRONOUNS = """saya aku kamu anda dia ia mereka kita kami beliau kalian engkau hamba -ku -mu -nya ini itu tersebut
sini sana situ""".split()
ADVERBS = """sangat amat sekali terlalu agak cukup paling lebih kurang tidak bukan belum sudah telah sedang akan
masih lagi juga pun hanya saja justru bahkan malah memang tentu pasti mungkin hampir segera selalu sering jarang
kadang selama""".split()
PARTICLES = "pun lah kah tah deh dong sih nih kok ya yah kan lho lo dah".split()
CLOSED = [(PREPOSITIONS, "Prep", "K"), (CONJUNCTIONS, "Konj", "?"), (PRONOUNS, "Pron", "S"), (ADVERBS, "Adv", "Mod"), (PARTICLES, "Part", "?")]
WHOLE = """pergi segar dapat pesan benar besar dalam depan belakang bersama selain sekitar setelah sebelum sesudah
setidaknya seharusnya semua setiap pernah penting penuh pendek panjang pertama terasa terlihat tersebut termasuk
terdapat berbeda berupa bersifat memang baru lama keras kecil indah bagus jelek cepat lambat tinggi rendah jauh
dekat kira mana sana sini situ kemarin besok lusa lantai dinding langit pantai sawah ladang kebun hutan gunung
sungai danau laut pulau negara bangsa makan minum tidur bangun duduk pulang datang tiba tinggal""".split()
LOANWORDS = """meeting upload download ghosting cancel update install login logout online offline streaming trending
posting sharing like comment follow unfollow block chat video foto story status repost screenshot""".split()
POS_CLASS = {"n": "N", "v": "V", "a": "Adj", "adv": "Adv", "adj": "Adj", "num": "Num", "pron": "Pron", "prep": "Prep", "konj": "Konj", "part": "Part", "p": "Prep"}

# ---- affixes: form, function, classes of a valid root, class of the result, spellings ------------------------------
PREFIXES = [
    ("me-", "verba_aktif", "V N Adj", "V", "me- mem- men- meng- meny- menge-"),
    ("di-", "verba_pasif", "V N", "V", "di-"),
    ("ber-", "verba_intransitif", "V N Adj", "V", "ber- be- bel-"),
    ("ter-", "verba_pasif_spontan", "V Adj", "V", "ter- te-"),
    ("per-", "kausatif", "V N Adj", "V", "per- pel-"),
    ("ke-", "numeralia_ordinal", "Num", "Num", "ke-"),
    ("se-", "kuantifikasi", "N Adj Num", "Adj", "se-"),
    ("pe-", "nominalisasi_agen", "V Adj", "N", "pe- pem- pen- peng- peny- penge-"),
]
SUFFIXES = [
    ("-kan", "kausatif_transitif", "V N Adj", "V"),
    ("-i", "verba_lokatif", "V N", "V"),
    ("-an", "nominalisasi", "V N Adj", "N"),
    ("-nya", "referensi_definit", "N V Adj", "N"),
    ("-lah", "penegas", "V Adj N", None),
    ("-kah", "interogatif", "V N Adj", None),
    ("-wan", "nominalisasi_profesi", "N Adj", "N"),
    ("-wati", "nominalisasi_profesi_fem", "N Adj", "N"),
]
CONFIXES = [
    ("ke-an", "nominalisasi_abstrak", "Adj V N", "N"),
    ("pe-an", "nominalisasi_proses", "V N", "N"),
    ("per-an", "nominalisasi_hasil", "V N", "N"),
    ("ber-an", "verba_resiprokal", "V", "V"),
    ("me-kan", "kausatif_aktif", "V N Adj", "V"),
    ("me-i", "verba_aktif_lokatif", "V N", "V"),
    ("di-kan", "pasif_kausatif", "V N Adj", "V"),
    ("di-i", "pasif_lokatif", "V N", "V"),
]
#: A spelling's root gets back its first letter.
RESTORED = {"meny-": "s", "peny-": "s"}
INFORMAL_EXAMPLES = "di-ghosting di-cancel di-PHP-in di-upload suruh-in kasih-in PHP-in ke-ghosting ke-baper ngomong ngaku ngeliat".split()

# ---- semantic domains ---------------------------------------------------------------------------------------------
DOMAINS = """kuliner kendaraan bangunan senjata busana pendidikan ekonomi kesehatan hukum seni olahraga teknologi alam
sosial agama pemerintahan ilmu budaya bahasa waktu""".split()
VECTOR_CLASSES = "n v a adv num pron prep konj part".split()
CLASS_DIMENSION = {"n": "n", "v": "v", "adj": "a", "adjektiva": "a", "adv": "adv", "adverbia": "adv", "num": "num", "pron": "pron", "prep": "prep", "konjungsi": "konj", "konj": "konj", "partikel": "part", "part": "part"}
DOMAIN_GROUPS = {"kuliner": "aktivitas_sipil", "ekonomi": "aktivitas_sipil", "busana": "aktivitas_sipil", "hukum": "sosial", "pendidikan": "sosial", "bangunan": "infrastruktur", "kendaraan": "infrastruktur", "kesehatan": "kesehatan", "alat_musik": "seni", "senjata": "konflik", "militer": "konflik"}
DOMAIN_PAIRS = {("ekonomi", "kuliner"): 0.6, ("kuliner", "ekonomi"): 0.6, ("ekonomi", "senjata"): 2.8, ("senjata", "ekonomi"): 2.8, ("kuliner", "senjata"): 3.0, ("senjata", "kuliner"): 3.0, ("ekonomi", "hukum"): 1.5, ("ekonomi", "pendidikan"): 1.5}
SAME_DOMAIN, RELATED_DOMAIN, OTHER_DOMAIN, ONE_UNKNOWN, BOTH_UNKNOWN = 0.2, 0.8, 2.5, 1.2, 1.0
NO_DOMAIN_POS = "bt p pron adv konj part num ark kl kp".split()
POS_PRIORITY = {"n": 3, "v": 3, "adj": 2, "a": 2, "adv": 1}
DOMAIN_OVERRIDES = {"rumah": "bangunan", "sayuran": "kuliner"} | dict.fromkeys(
    "pergi datang berlari berjalan bergerak akan sudah telah sedang belum pernah budi sakit toko baru lama indah sari dewi melati".split())
#: Words of a definition that say a domain: one is enough (2 points each), or two are needed (1 point each).
STRONG_WORDS = {
    "kuliner": "makanan,masakan,minuman,bumbu,kuliner,dimasak,direbus,dikukus,lauk,hidangan,rempah",
    "senjata": "senjata,peluru,senapan,meriam,pistol,pedang,keris,tombak,panah,granat,amunisi,bedil,senjata api,senapan api",
    "kendaraan": "kendaraan,berkendara,dikendarai,mesin kendaraan,transportasi,angkutan umum",
    "kesehatan": "penyakit,medis,klinis,farmasi,rumah sakit,infeksi,bakteri,virus,pengobatan,terapi",
    "hukum": "hukum,undang-undang,pidana,perdata,pengadilan,jaksa,hakim,terdakwa,putusan,vonis,sanksi",
    "ekonomi": "ekonomi,keuangan,bisnis,perdagangan,transaksi,investasi,kredit,modal usaha",
    "pendidikan": "pendidikan,akademik,kurikulum,mahasiswa,universitas,diploma,mata pelajaran",
    "bangunan": "bangunan,arsitektur,konstruksi bangunan,arsitek,pondasi,beton,batu bata,struktur bangunan,denah,gedung bertingkat",
    "busana": "pakaian,busana,tekstil,menjahit,seragam,kostum,lengan baju",
    "alat_musik": "alat musik,melodi,harmoni,orkestra,musisi,instrumen musik",
}
WEAK_WORDS = {
    "kuliner": "makan,nasi,sayur,buah,daging,ikan,resep,rasa,enak,sedap,lezat,menu,beras,sayuran",
    "senjata": "perang,pertempuran,militer,tentara,menyerang",
    "kendaraan": "mobil,motor,kereta,pesawat,kapal,sepeda,bus,truk,roda",
    "kesehatan": "obat,dokter,pasien,sakit,sembuh,gejala",
    "hukum": "pasal,peraturan,regulasi,denda,hukuman",
    "ekonomi": "dagang,pasar,harga,jual,beli,uang,untung,rugi,bank",
    "pendidikan": "sekolah,belajar,ilmu,guru,siswa,pelajaran,ujian,nilai",
    "bangunan": "gedung,konstruksi,renovasi,tembok,semen",
    "busana": "baju,celana,rok,kemeja,kain,mode,fashion,kancing,kerah",
    "alat_musik": "musik,nada,gitar,piano,biola,seruling,drum,gamelan,lagu,bernyanyi",
}

# ---- constraints ----------------------------------------------------------------------------------------------------
WEIGHTS = {"morfologis": 0.28, "sintaktis": 0.23, "semantik": 0.32, "leksikal": 0.09, "animasi": 0.08}
DIMENSIONS = [*WEIGHTS, "topologis"]
ANIMATE_VERBS = """tangis menangis menangisi tawa tertawa menertawakan sedih bersedih marah murka gusar takut khawatir
cemas senang gembira bahagia rindu kangen malu sungkan benci dendam cinta sayang mencintai menyayangi pikir berpikir
memikir memikirkan ingat mengingat lupa melupakan paham mengerti memahami tahu mengetahui percaya mempercayai ragu
meragukan sadar menyadari harap berharap ingin menginginkan bermimpi memutuskan putus memilih pilih memerintah
perintah bersidang sidang berunding runding bernegosiasi berkata kata berteriak meneriakkan berbisik membisikkan
berdoa memohon mengeluh keluh mengaku aku berjanji janji""".split()
ANIMATE_PREFIXES = ("me", "ber", "ter", "di", "ke", "pe")
HUMANS = """orang manusia seseorang individu masyarakat penduduk warga rakyat umat dokter guru hakim jaksa polisi
tentara prajurit petani nelayan pedagang pegawai karyawan buruh mahasiswa siswa pelajar murid dosen presiden menteri
gubernur bupati walikota direktur manajer atasan bawahan kolega pasien terdakwa saksi tersangka narapidana anak ayah
ibu kakak adik saudara keluarga suami istri teman sahabat musuh lawan kawan pemimpin ketua anggota peserta pengunjung
penumpang pengemudi sopir pilot penulis pembicara pendengar penonton kurir komisaris sekretaris bendahara konsultan
auditor notaris pengacara advokat kepala wakil staf relawan petugas pejabat wali narasumber perwakilan delegasi saya
aku kamu anda dia ia kami kita mereka beliau kalian""".split()
ANIMALS = """anjing kucing burung ikan ayam sapi kambing kuda harimau singa gajah monyet kera tikus kelinci bebek angsa
ular buaya kura-kura""".split()
MODIFIES = {"Adj": "N N_proper N_serapan", "Adv": "V Adj V_serapan", "Num": "N N_proper"}
TEMPORAL = "sedang sudah telah akan belum pernah lagi masih baru langsung segera".split()
DATIVE = ["kepada", "terhadap"]
NEUTRAL_VERBS = """beli jual dagang niaga bayar sewa pinjam pinjamkan beri berikan hibah hadiahkan miliki punya simpan
pegang dapat terima ambil bawa taruh letakkan tempatkan kirim antar angkut muat pindahkan lihat tahu kenal ingat cari
temukan pelajari buat bangun produksi ciptakan hasilkan kembangkan pakai gunakan manfaatkan butuhkan perlukan""".split()
INCOMPATIBLE = {"kuliner": "senjata kendaraan alat_musik", "pendidikan": "senjata kendaraan", "kesehatan": "senjata alat_musik", "senjata": "kuliner pendidikan kesehatan"}
COMPLEMENT_MARKS = "antara lain yaitu yakni ialah meliputi terdiri misalnya contohnya".split()
COMPLEMENT_PHRASES = ["antara lain", "terdiri dari", "terdiri atas", "sebagai berikut"]
COMPLEMENT_WORDS = "yaitu yakni adalah ialah meliputi misalnya contohnya".split()
THRESHOLD = 1.5

# ---- propositions, frames, knowledge -------------------------------------------------------------------------------
NEGATIONS = "tidak bukan tak tiada jangan belum tanpa".split()
MODALS = {"harus": "harus", "wajib": "harus", "perlu": "harus", "boleh": "boleh", "dapat": "boleh", "bisa": "boleh", "mungkin": "mungkin", "barangkali": "mungkin", "kiranya": "mungkin", "pasti": "pasti", "tentu": "pasti"}
VERB_PREFIXES = ("me", "ber", "ter", "per", "memper", "diper")
PREPOSITION_SLOTS = {"di": "LOKASI", "pada": "LOKASI", "dalam": "LOKASI", "dari": "ASAL", "asal": "ASAL", "ke": "TUJUAN", "kepada": "PENERIMA", "untuk": "TUJUAN", "bagi": "PENERIMA", "demi": "TUJUAN", "ketika": "WAKTU", "saat": "WAKTU", "sejak": "WAKTU", "sampai": "WAKTU", "selama": "WAKTU", "dengan": "CARA", "secara": "CARA", "melalui": "CARA", "karena": "SEBAB", "akibat": "SEBAB", "lantaran": "SEBAB", "jika": "SYARAT", "apabila": "SYARAT", "bila": "SYARAT", "kalau": "SYARAT"}
#: name, trigger verbs, slots (a star marks required ones), domain
FRAMES = [
    ("JUAL_BELI", "beli jual dagang bayar barter transaksi sewa lelang tenda niaga perdagangkan", "pembeli* barang* penjual harga lokasi waktu", "ekonomi"),
    ("PERJALANAN", "pergi berangkat tiba datang pulang kembali lewat melintasi melewati menuju menempuh berlayar terbang berkendara berjalan bawa", "pelaku* tujuan* asal moda waktu tujuan_final", "aktivitas"),
    ("KOMUNIKASI", "bicara katakan beritahu sampaikan lapor ceritakan jelaskan tanya minta perintah surat kirim tulis baca umumkan nyatakan", "pengirim* pesan* penerima media waktu", "aktivitas"),
    ("PENDIDIKAN", "ajar belajar didik latih bimbing mentor kursus sekolah kuliah studi ujian nilai lulus wisuda dosen guru pelajar pelajari", "pengajar pelajar* materi* tempat waktu", "pendidikan"),
    ("KESEHATAN", "rawat obat periksa diagnosa operasi sembuh sakit resep konsultasi vaksin imunisasi suntik infus bedah terapi rehabilitasi luka patah demam meresepkan memeriksa mengoperasi mendiagnosis merawat mengobati memvaksinasi merehabilitasi", "tenaga_medis pasien* kondisi tindakan* tempat", "kesehatan"),
    ("HUKUM_PIDANA", "dakwa tuntut adili vonis hukum tangkap tahan sidang jaksa hakim gugat banding kasasi eksekusi bebaskan rehabilitasi jatuhkan putuskan tetapkan ancam jatuh", "terdakwa* penuntut hakim perbuatan* pasal putusan", "hukum"),
    ("PEMBUATAN", "buat bangun ciptakan produksi rancang desain dirikan konstruksi fabrikasi rakit tulis lukis pahat jahit masak", "pembuat* hasil* bahan cara tujuan", "aktivitas"),
    ("KEPEMILIKAN", "miliki punya dapat terima kehilangan mewarisi menyerahkan menghibahkan mengalihkan", "pemilik* objek* sumber waktu", "ekonomi"),
    ("ATRIBUSI", "adalah ialah merupakan menjadi tampak terlihat terasa terdengar", "entitas* atribut* kondisi", "deskriptif"),
    ("KONFLIK", "lawan perang bertarung bersaing berkompetisi menyerang mempertahankan menentang melawan protes demonstrasi mogok", "pihak_1* pihak_2* sebab lokasi hasil", "sosial"),
    ("PEMERINTAHAN", "atur terapkan keluarkan terbitkan sahkan cabut amandemen bangun anggarkan alokasikan resmikan lantik copot pecat tetapkan putuskan berlakukan implementasikan umumkan luncurkan reformasi mengeluarkan menerbitkan", "otoritas* kebijakan* sasaran tujuan waktu", "hukum"),
    ("EKSISTENSI", "ada terdapat hadir muncul terletak berlokasi berada tinggal berdomisili", "entitas* lokasi waktu kondisi", "deskriptif"),
]
FRAME_PREFIXES = ("menge", "meng", "meny", "mem", "men", "me", "ber", "ter", "di", "ke")
SLOT_TO_FRAME = [
    ("AGEN", "pembeli pelaku pengirim pengajar pembuat pemilik penuntut pihak_1 otoritas tenaga_medis"),
    ("PASIEN", "barang pasien pelajar terdakwa objek"),
    ("PENERIMA", "penerima pihak_2"),
    ("LOKASI", "lokasi tempat"),
    ("TUJUAN", "tujuan tujuan_final"),
    ("ASAL", "asal sumber"),
    ("CARA", "cara moda media"),
    ("SEBAB", "sebab"),
    ("WAKTU", "waktu"),
    ("TEMA", "materi pesan kebijakan perbuatan hasil"),
    ("HASIL", "hasil putusan"),
    ("ATRIBUT", "atribut entitas"),
]
SLOTS = [s for s, _ in SLOT_TO_FRAME] + ["SYARAT"]
SUPERTYPES = {
    "PERSONA": "ENTITAS", "ORGANISASI": "ENTITAS", "LOKASI": "ENTITAS", "BENDA": "ENTITAS", "ABSTRAK": "ENTITAS", "WAKTU": "ENTITAS",
    "PROFESI_MEDIS": "PERSONA", "PROFESI_HUKUM": "PERSONA", "PROFESI_DIDIK": "PERSONA", "PEJABAT": "PERSONA", "WARGA": "PERSONA",
    "INSTITUSI_HUKUM": "ORGANISASI", "INSTITUSI_MEDIS": "ORGANISASI", "INSTITUSI_DIDIK": "ORGANISASI", "INSTITUSI_PEMERINTAH": "ORGANISASI",
    "PERUSAHAAN": "ORGANISASI", "LOKASI_EKONOMI": "LOKASI", "LOKASI_ALAM": "LOKASI", "HUKUM_NORMA": "ABSTRAK", "PENYAKIT": "ABSTRAK",
    "PENGETAHUAN": "ABSTRAK", "HAK": "ABSTRAK",
}
ENTITY_TYPES = {
    "dokter": "PROFESI_MEDIS", "perawat": "PROFESI_MEDIS", "bidan": "PROFESI_MEDIS", "apoteker": "PROFESI_MEDIS", "hakim": "PROFESI_HUKUM",
    "jaksa": "PROFESI_HUKUM", "pengacara": "PROFESI_HUKUM", "notaris": "PROFESI_HUKUM", "polisi": "PROFESI_HUKUM", "penyidik": "PROFESI_HUKUM",
    "guru": "PROFESI_DIDIK", "dosen": "PROFESI_DIDIK", "pengajar": "PROFESI_DIDIK", "profesor": "PROFESI_DIDIK", "presiden": "PEJABAT",
    "menteri": "PEJABAT", "gubernur": "PEJABAT", "bupati": "PEJABAT", "direktur": "PEJABAT", "siswa": "WARGA", "mahasiswa": "WARGA", "pasien": "WARGA",
    "terdakwa": "WARGA", "tersangka": "WARGA", "korban": "WARGA", "warga": "WARGA", "murid": "WARGA", "pengadilan": "INSTITUSI_HUKUM",
    "kejaksaan": "INSTITUSI_HUKUM", "kepolisian": "INSTITUSI_HUKUM", "kpk": "INSTITUSI_HUKUM", "mahkamah": "INSTITUSI_HUKUM",
    "rumah_sakit": "INSTITUSI_MEDIS", "puskesmas": "INSTITUSI_MEDIS", "klinik": "INSTITUSI_MEDIS", "apotek": "INSTITUSI_MEDIS",
    "sekolah": "INSTITUSI_DIDIK", "universitas": "INSTITUSI_DIDIK", "kampus": "INSTITUSI_DIDIK", "pesantren": "INSTITUSI_DIDIK",
    "pemerintah": "INSTITUSI_PEMERINTAH", "kementerian": "INSTITUSI_PEMERINTAH", "dpr": "INSTITUSI_PEMERINTAH", "pasar": "LOKASI_EKONOMI",
    "toko": "LOKASI_EKONOMI", "bank": "LOKASI_EKONOMI", "sungai": "LOKASI_ALAM", "gunung": "LOKASI_ALAM", "hutan": "LOKASI_ALAM", "pantai": "LOKASI_ALAM",
    "sawah": "LOKASI_ALAM", "hukuman": "HUKUM_NORMA", "putusan": "HUKUM_NORMA", "vonis": "HUKUM_NORMA", "peraturan": "HUKUM_NORMA",
    "dakwaan": "HUKUM_NORMA", "tuntutan": "HUKUM_NORMA", "covid": "PENYAKIT", "diabetes": "PENYAKIT", "hipertensi": "PENYAKIT", "kanker": "PENYAKIT",
    "demam": "PENYAKIT",
}
ACTION_TYPES = {
    "beri": "transfer", "berikan": "transfer", "jual": "transfer", "beli": "transfer", "serahkan": "transfer", "kirim": "transfer", "bayar": "transfer",
    "hibah": "transfer", "membeli": "transfer", "menjual": "transfer", "memberi": "transfer", "menyerahkan": "transfer", "mengirim": "transfer",
    "membayar": "transfer", "serah": "transfer", "pergi": "perjalanan", "berangkat": "perjalanan", "pulang": "perjalanan", "tiba": "perjalanan",
    "datang": "perjalanan", "menuju": "perjalanan", "pindah": "perjalanan", "bawa": "perjalanan", "berpindah": "perjalanan", "membawa": "perjalanan",
    "bicara": "komunikasi", "katakan": "komunikasi", "sampaikan": "komunikasi", "beritahu": "komunikasi", "lapor": "komunikasi", "umumkan": "komunikasi",
    "nyatakan": "komunikasi", "tulis": "komunikasi", "berbicara": "komunikasi", "melaporkan": "komunikasi", "menyampaikan": "komunikasi",
    "memberitahu": "komunikasi", "jatuhkan": "hukum", "vonis": "hukum", "dakwa": "hukum", "tuntut": "hukum", "tangkap": "hukum", "tahan": "hukum",
    "bebaskan": "hukum", "hukum": "hukum", "putuskan": "hukum", "adili": "hukum", "menangkap": "hukum", "menahan": "hukum", "mendakwa": "hukum",
    "menuntut": "hukum", "memvonis": "hukum", "mengadili": "hukum", "memutuskan": "hukum", "menjatuhkan": "hukum", "membebaskan": "hukum",
    "mengeluarkan": "hukum", "menerbitkan": "hukum", "mengesahkan": "hukum", "memberlakukan": "hukum", "mencabut": "hukum", "mengumumkan": "hukum",
    "melantik": "hukum", "memecat": "hukum", "meresmikan": "hukum", "lantik": "hukum", "pecat": "hukum", "resmikan": "hukum", "jatuh": "hukum",
    "voniskan": "hukum", "dakwakan": "hukum", "tuntutkan": "hukum", "adil": "hukum", "bebas": "hukum", "periksa": "medis", "diagnosa": "medis",
    "obati": "medis", "rawat": "medis", "operasi": "medis", "bedah": "medis", "suntik": "medis", "terapi": "medis", "vaksinasi": "medis",
    "memeriksa": "medis", "mendiagnosis": "medis", "mengobati": "medis", "merawat": "medis", "mengoperasi": "medis", "menyuntik": "medis",
    "meresepkan": "medis", "memvaksinasi": "medis", "merehabilitasi": "medis", "diagnos": "medis", "obat": "medis", "ajar": "didik", "didik": "didik",
    "latih": "didik", "bimbing": "didik", "belajar": "didik", "lulus": "didik", "mengajar": "didik", "mendidik": "didik", "melatih": "didik",
    "membimbing": "didik", "mempelajari": "didik", "buat": "buat", "bangun": "buat", "ciptakan": "buat", "produksi": "buat", "rancang": "buat",
    "masak": "buat", "hancur": "rusak", "rusak": "rusak", "bakar": "rusak", "bunuh": "rusak", "serang": "rusak",
}
ACTION_PREFIXES = ("memper", "diper", "meng", "meny", "mem", "men", "me", "ber", "ter", "per", "di")
#: name, action, agent type, patient type, conclusions, domain, priority
WORLD_RULES = [
    ("TRANSFER_KEPEMILIKAN", "transfer", "PERSONA", None, ["penerima MEMILIKI pasien", "agen TIDAK_LAGI_MEMILIKI pasien"], "universal", 3),
    ("PERUBAHAN_LOKASI", "perjalanan", "PERSONA", None, ["agen BERADA_DI tujuan", "agen TIDAK_LAGI_DI asal"], "universal", 3),
    ("KOMUNIKASI_IMPLISIT", "komunikasi", "PERSONA", None, ["penerima MENGETAHUI pesan"], "universal", 2),
    ("VONIS_MENGUBAH_STATUS", "hukum", "PROFESI_HUKUM", "HUKUM_NORMA", ["penerima STATUS_MENJADI terpidana", "penerima WAJIB menjalani putusan", "agen TELAH_MEMUTUS kasus"], "hukum", 3),
    ("PENANGKAPAN_MEMBATASI_KEBEBASAN", "hukum", "PROFESI_HUKUM", "WARGA", ["pasien KEBEBASAN_DIBATASI", "pasien BERADA_DI tahanan"], "hukum", 3),
    ("DIAGNOSIS_MENETAPKAN_KONDISI", "medis", "PROFESI_MEDIS", "WARGA", ["pasien MEMILIKI_KONDISI penyakit", "pasien MEMBUTUHKAN pengobatan", "agen BERTANGGUNG_JAWAB atas kondisi pasien"], "kesehatan", 3),
    ("MENGAJAR_TRANSFER_PENGETAHUAN", "didik", "PROFESI_DIDIK", "WARGA", ["pasien MEMPELAJARI materi", "pasien PENGETAHUAN_BERTAMBAH"], "pendidikan", 2),
    ("PEMBUATAN_MENGHASILKAN_ENTITAS", "buat", None, None, ["hasil ADA setelah aksi", "agen MEMILIKI hasil"], "universal", 2),
    ("PERUSAKAN_MENGUBAH_STATE", "rusak", None, None, ["pasien KONDISI_MENJADI rusak_atau_tidak_ada"], "universal", 3),
]
PERSONAL_ONE = "dia ia beliau anda kamu engkau -nya nya".split()
PERSONAL_MANY = "mereka kalian kami kita".split()
DEMONSTRATIVES = "itu tersebut tadi dimaksud".split()

# ---- second morphology: prefixes, suffixes, confixes, function words -------------------------------------------------
PREFIXES2 = "me meng mem men meny ber be ter di ke pe peng pem pen peny per se mempel memper diper".split()
SUFFIXES2 = "kan an i nya ku mu lah kah tah pun".split()
CONFIXES2 = [("ke", "an"), ("per", "an"), ("pe", "an"), ("ber", "an"), ("se", "nya")]
PREFIX_POS = dict.fromkeys("me meng mem men meny ber be ter di mempel memper diper".split(), "V") | dict.fromkeys("pe peng pem pen peny per ke".split(), "N") | {"se": "ADV"}
FUNCTION_WORDS = {
    "saya": "PRON", "aku": "PRON", "kamu": "PRON", "kau": "PRON", "dia": "PRON", "ia": "PRON", "kami": "PRON", "kita": "PRON", "mereka": "PRON",
    "anda": "PRON", "di": "P", "ke": "P", "dari": "P", "dengan": "P", "untuk": "P", "pada": "P", "oleh": "P", "tentang": "P", "dalam": "P", "atas": "P",
    "bagi": "P", "antara": "P", "sekitar": "P", "melalui": "P", "dan": "CONJ", "atau": "CONJ", "tetapi": "CONJ", "namun": "CONJ", "karena": "CONJ",
    "sehingga": "CONJ", "agar": "CONJ", "jika": "CONJ", "bahwa": "CONJ", "meskipun": "CONJ", "walaupun": "CONJ", "yang": "REL", "sudah": "ADV",
    "telah": "ADV", "akan": "ADV", "sedang": "ADV", "belum": "ADV", "tidak": "ADV", "bukan": "ADV", "juga": "ADV", "hanya": "ADV", "sangat": "ADV",
    "lebih": "ADV", "paling": "ADV", "masih": "ADV", "selalu": "ADV", "lagi": "ADV", "pun": "ADV", "ini": "DET", "itu": "DET", "tersebut": "DET",
    "para": "DET", "semua": "DET", "setiap": "DET", "beberapa": "DET", "suatu": "DET", "sebuah": "DET", "seorang": "DET", "segala": "DET", "satu": "NUM",
    "dua": "NUM", "tiga": "NUM", "empat": "NUM", "lima": "NUM", "enam": "NUM", "tujuh": "NUM", "delapan": "NUM", "sembilan": "NUM", "sepuluh": "NUM",
    "seratus": "NUM", "seribu": "NUM", "pertama": "NUM", "kedua": "NUM", "ketiga": "NUM",
}
DICTIONARY_POS = {"v": "V", "vi": "V", "vt": "V", "n": "N", "adj": "ADJ", "adv": "ADV", "p": "P", "pron": "PRON", "num": "NUM", "cak": "N", "ki": "ADJ", "ark": "N", "ref": "N", "bt": "N", "konjung": "CONJ", "konj": "CONJ"}
SPECIALS = ["<PAD>", "<UNK>", "<BOS>", "<EOS>"]

# ---- metrics ----------------------------------------------------------------------------------------------------------
UNDERIVED = "di ke dari dan atau yang ini itu".split()
ACTIVE_PREFIXES = "me mem men meng meny ber".split()
#: Roles that may follow each other.
ROLE_STEPS = [("S", "P"), ("P", "O"), ("P", "K"), ("S", "K"), ("O", "K"), ("K", "K"), ("?", "S"), ("?", "P"), ("?", "O"), ("?", "K"), ("?", "?"), ("S", "?"), ("P", "?"), ("O", "?"), ("K", "?")]

# ---- dependency heads -----------------------------------------------------------------------------------------------
COPULAS = "adalah merupakan ialah yakni yaitu".split()
BEHIND_NOUN = "ini itu tersebut".split()
#: Tags that go with a dictionary class (by its first letter) of a neighbour.
COMPATIBLE_POS = {"v": "n adj adv", "n": "v adj p", "adj": "n v adv", "p": "n pron"}
AFFIXES2 = ["<PAD>", "<NONE>", *PREFIXES2, *SUFFIXES2, *[f"{p}+{s}" for p, s in CONFIXES2]]

# ---- training data and noise ------------------------------------------------------------------------------------------
ACTION_VERBS = """makan memakan minum meminum membaca baca membacakan bekerja kerja mengerjakan pergi berangkat menuju pulang
memasak masak menggoreng merebus menumis memanggang belajar mempelajari mengajar memeriksa mengecek mendiagnosis menetapkan
mengeluarkan mengumumkan mengesahkan""".split()
DOMAIN_WORDS = {
    "makan": "makan memakan nasi roti mie sayur ikan daging makanan lauk minum lapar kenyang",
    "membaca": "membaca baca buku artikel novel koran teks halaman cerita bacaan",
    "bekerja": "bekerja kerja kantor laporan tugas proyek rapat karyawan pekerjaan",
    "pergi": "pergi berangkat menuju pulang naik pasar toko sekolah",
    "memasak": "memasak menggoreng merebus menumis memanggang masak dapur bumbu",
    "belajar": "belajar pelajaran ujian sekolah guru murid siswa tugas matematika",
    "memeriksa": "memeriksa mengecek pasien dokter perawat kesehatan obat klinik",
    "formal": "pemerintah kebijakan peraturan menteri undang negara aturan keputusan",
}
OBJECTS = {
    "makan": "nasi roti mie sayur ikan daging makanan lauk", "memakan": "nasi roti buah makanan", "minum": "air susu teh kopi jus", "membaca": "buku artikel novel koran teks cerita",
    "baca": "buku artikel koran", "bekerja": "laporan proyek tugas", "mengerjakan": "tugas laporan pekerjaan", "pergi": "sekolah pasar kantor toko", "menuju": "sekolah pasar kantor",
    "memasak": "nasi sayur ikan sup mie", "menggoreng": "ikan ayam tempe tahu", "merebus": "air sayur mie", "belajar": "matematika bahasa sains pelajaran", "mempelajari": "materi pelajaran buku",
    "memeriksa": "pasien kesehatan kondisi", "mengecek": "laporan kondisi pasien", "menetapkan": "kebijakan peraturan keputusan", "mengeluarkan": "kebijakan peraturan aturan",
}
#: The first form stands three times: it weighs three times as much.
TEMPLATES = ["{subj} {verb} {obj}", "{subj} {verb} {obj}", "{subj} {verb} {obj}", "{subj} sedang {verb} {obj}", "{subj} akan {verb} {obj}", "{subj} sudah {verb} {obj}",
             "{subj} mulai {verb} {obj}", "{subj} ingin {verb} {obj}", "{verb} {obj}", "{verb} {obj} itu", "{verb} {obj} setiap hari"]
SUBJECTS = "saya dia mereka kami kita ibu ayah anak guru dokter murid siswa pasien pemerintah".split()
NOISE_PREFIXES = "meng mem ber ter di ke se per".split()
NOISE_SUFFIXES = "kan an i nya".split()

# ---- vocabulary ---------------------------------------------------------------------------------------------------------
#: Words that a vocabulary should have, by field.
FIELD_SEEDS = {
    "makan": "makan minum nasi makanan", "membaca": "baca buku kata teks", "berjalan": "jalan kaki gerak pergi", "bekerja": "kerja kantor tugas laporan",
    "pemerintah": "pemerintah hukum negara kebijakan", "pendidikan": "sekolah belajar guru ilmu", "sejarah": "sejarah tahun masa perang", "sains": "penelitian data hasil ilmu",
}
