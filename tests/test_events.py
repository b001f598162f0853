"""Goals and cards, one way of telling at a time."""

from reelmill.operators import segments


def frame(spark, texts):
    return spark.createDataFrame([(v, 0, t) for v, t in enumerate(texts)], "video_id long, seg_no long, text string")


def test_goals(spark):
    texts = ["34. dakikada Metin Oktay gol.", "golü attı, Lefter Küçük 71", "Can Bartu golü: 12", "34. dakikada Metin Oktay gol. ama gol yok", "gole çok yaklaştı Can Bartu gol 12", "nothing here", None]
    got = {(r["video_id"], r["minute"], r["player"]) for r in segments.goals(frame(spark, texts)).collect()}
    assert got == {(0, 34, "Metin Oktay"), (1, 71, "Lefter Küçük"), (2, 12, "Can Bartu")}


def test_cards(spark):
    texts = ["sarı kart 23. dakika Alpaslan", "kırmızı kart, Rasim Kara 61", "Ali Veli sarı kart gördü 15", "maçın 70. dakikasında Rasim Kara kırmızı kart gördü", "yellow card: 5 Jon Doe", "kart yok"]
    got = {(r["video_id"], r["kind"], r["minute"], r["player"]) for r in segments.cards(frame(spark, texts)).collect()}
    assert got >= {(0, "sarı kart", 23, "Alpaslan"), (1, "kırmızı kart", 61, "Rasim Kara"), (2, "sarı kart", 15, "Ali Veli"), (3, "kırmızı kart", 70, "Rasim Kara"), (4, "sarı kart", 5, "Jon Doe")}
    assert {g[0] for g in got} == {0, 1, 2, 3, 4}


def test_match_facts(spark):
    rows = [(1, 0, "Bugün Lig'de ve Mersin'de. Maçın hakemi Cüneyt Çakır, sonra"), (1, 1, "Bahattin Duran ve Tarık Ongun birinci yardımcıları. Ali Palabıyık da dördüncü hakem"), (1, 2, "SÜPER LİG. maçın hakemi Başka Biri"), (2, 0, "PTT 1. LİG"), (3, 0, "nothing"), (3, 1, None)]
    df = spark.createDataFrame(rows, "video_id long, seg_no long, text string")
    got = {r["video_id"]: tuple(r)[1:] for r in segments.match_facts(df).collect()}
    assert got[1] == ("Cüneyt Çakır", "Bahattin Duran", "Tarık Ongun", "Ali Palabıyık", "SÜPER LİG", "Mersin")
    assert got[2] == (None, None, None, None, "PTT 1. LİG", None) and got[3] == (None,) * 6
