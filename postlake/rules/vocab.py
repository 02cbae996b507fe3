"""Codes and their display labels (codes are stored, labels are shown)."""

EMPLOYMENT_TYPE = {
    "FULL_TIME": "Penuh waktu",
    "PART_TIME": "Paruh waktu",
    "CONTRACT": "Kontrak",
    "TEMPORARY": "Sementara",
    "INTERNSHIP": "Magang",
    "FREELANCE": "Freelance",
    "APPRENTICESHIP": "Pemagangan",
    "PROJECT_BASED": "Berbasis proyek",
    "VOLUNTEER": "Sukarela",
    "UNKNOWN": "Tidak dicantumkan",
}
WORK_ARRANGEMENT = {
    "ONSITE": "Di kantor",
    "HYBRID": "Hybrid",
    "REMOTE": "Remote",
    "FIELD": "Lapangan",
    "UNKNOWN": "Tidak dicantumkan",
}
EDUCATION_LEVEL = {
    "SD": "SD",
    "SMP": "SMP",
    "SMA_SMK": "SMA/SMK",
    "DIPLOMA": "Diploma (D1–D4)",
    "BACHELOR": "Sarjana (S1)",
    "PROFESSIONAL": "Pendidikan profesi",
    "MASTER": "Magister (S2)",
    "DOCTORATE": "Doktor (S3)",
    "UNKNOWN": "Tidak dicantumkan",
}
EXPERIENCE_BAND = {
    "UNDER_1": "< 1 tahun",
    "Y1_3": "1–3 tahun",
    "Y3_5": "3–5 tahun",
    "Y5_10": "5–10 tahun",
    "OVER_10": "> 10 tahun",
    "UNKNOWN": "Tidak dicantumkan",
}
SALARY_STATUS = {
    "DISCLOSED": "Dicantumkan",
    "NOT_DISCLOSED": "Tidak dicantumkan",
    "NEGOTIABLE": "Dapat dinegosiasikan",
    "INVALID": "Tidak valid",
    "UNPARSEABLE": "Tidak dapat dibaca",
}
SALARY_PERIOD = {
    "HOUR": "per jam",
    "DAY": "per hari",
    "WEEK": "per minggu",
    "MONTH": "per bulan",
    "YEAR": "per tahun",
    "UNKNOWN": "periode tidak diketahui",
}
FRESHNESS = {
    "POTENTIALLY_ACTIVE": "Baru terlihat, belum diverifikasi",
    "NOT_SEEN_RECENTLY": "Riwayat lowongan",
    "EXPIRED_BY_SOURCE": "Kedaluwarsa menurut sumber",
}
OBSERVATION_METHOD = {
    "ARCHIVE": "Arsip web",
    "SNAPSHOT": "Snapshot historis",
    "LIVE": "Langsung dari sumber",
}
PERMISSION_STATUS = {
    "DISCOVERED": "Ditemukan",
    "NEEDS_REVIEW": "Perlu ditinjau",
    "APPROVED": "Diizinkan (izin/lisensi tercatat)",
    "APPROVED_WITH_CONDITIONS": "Boleh dipakai dengan syarat",
    "REQUIRES_WRITTEN_PERMISSION": "Perlu izin tertulis",
    "BLOCKED": "Diblokir",
    "PAUSED": "Dijeda",
    "RETIRED": "Dihentikan",
}
RUNNABLE_PERMISSION = ("APPROVED", "APPROVED_WITH_CONDITIONS")
RUN_STATUS = {
    "RUNNING": "Berjalan",
    "SUCCEEDED": "Berhasil",
    "PARTIAL": "Berhasil sebagian",
    "FAILED": "Gagal",
    "REFUSED": "Ditolak kebijakan",
}
ROLE_FAMILY = {
    "SOFTWARE_ENGINEERING": "Rekayasa Perangkat Lunak",
    "DATA_ANALYTICS": "Data & Analitik",
    "INFRASTRUCTURE_DEVOPS": "Infrastruktur & DevOps",
    "QUALITY_ASSURANCE": "Quality Assurance & Pengujian",
    "IT_SUPPORT": "Dukungan & Administrasi TI",
    "PRODUCT_PROJECT": "Produk & Manajemen Proyek",
    "DESIGN_CREATIVE": "Desain & Kreatif",
    "MARKETING": "Pemasaran",
    "SALES_BUSINESS": "Penjualan & Pengembangan Bisnis",
    "FINANCE_ACCOUNTING": "Keuangan & Akuntansi",
    "HUMAN_RESOURCES": "SDM & Rekrutmen",
    "ADMIN_OPERATIONS": "Administrasi & Operasional",
    "CUSTOMER_SERVICE": "Layanan Pelanggan",
    "SUPPLY_CHAIN": "Rantai Pasok & Pengadaan",
    "ENGINEERING": "Teknik (Non-Perangkat Lunak)",
    "GRADUATE_PROGRAM": "Program Lulusan & Management Trainee",
    "EDUCATION": "Pendidikan & Pelatihan",
    "HEALTHCARE": "Kesehatan",
    "LEGAL": "Hukum & Kepatuhan",
    "FOOD_HOSPITALITY": "Makanan, Minuman & Perhotelan",
    "RETAIL_STORE": "Ritel & Toko",
    "TRANSPORT_DELIVERY": "Transportasi & Pengiriman",
    "PRODUCTION": "Produksi & Pabrik",
    "SECURITY_FACILITIES": "Keamanan & Kebersihan",
    "OTHER": "Lainnya / Belum terklasifikasi",
}
MISSING_LABEL = "Tidak dicantumkan"
