from postlake.operators import clustering


def test_sweep_measures_and_choice(spark):
    titles = ["data engineer", "data analyst", "senior data engineer", "kasir toko", "kasir minimarket", "sopir truk", "sopir box", "c++ developer"] * 3
    df = spark.createDataFrame([(i, t, t.split()[0]) for i, t in enumerate(titles)], "row_id int, job_title string, family string")
    vectors = clustering.title_vectors(df, "job_title", "tokens", single_partition=True, features=64)
    measures = clustering.sweep(vectors, "row_id", ks=(2, 3), seeds=(42, 7), reference="family").cache()
    rows = measures.collect()
    assert len(rows) == 4 and all(-1 <= r.silhouette_cosine <= 1 and -1e-9 <= r.nmi <= 1 + 1e-9 and r.ari_min <= r.ari_mean + 1e-9 for r in rows)
    best = clustering.best_fit(measures, minimum=1).first()
    assert best.silhouette_sq == max(r.silhouette_sq for r in rows)
    assert clustering.empty_token_rows(df, "job_title").first().rows == 3  # "c++ developer" leaves blanks
    assert clustering.title_vectors(df, "job_title", "letters").count() == 24
