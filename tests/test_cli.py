import json

import pytest

from cuewright import config as C
from cuewright.cli import main


def words(text):
    return [{"start": i * 0.5, "end": i * 0.5 + 0.4, "text": w, "seg_idx": 0} for i, w in enumerate(text.split())]


def read(path):
    return path.read_text(encoding="utf-8-sig")


def test_segment_and_translate(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ep1.json").write_text(json.dumps([{"start": None, "end": 1.0, "text": "lost", "seg_idx": 0}, {"start": 0.0, "end": 0.1, "text": "　\t", "seg_idx": 0}, *words("We left the old pier. It rained all day.")]))
    assert main(["segment", str(tmp_path / "in"), str(tmp_path / "srt")]) == 0
    assert "We left the old pier." in read(tmp_path / "srt" / "ep1.srt") == read(tmp_path / "srt" / "ep1.txt")
    assert main(["translate", str(tmp_path / "srt"), str(tmp_path / "out"), "--target", "french", "--ext", "*.srt"]) == 0
    assert "It rained all day." in read(tmp_path / "out" / "ep1_FR.srt")
    said = capsys.readouterr().out
    assert "2 cues, 9 words, 0 over the limits" in said and "2 files" in said


def test_texts_of_any_encoding(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("Der Töpfer schlief.\n\n  Das Boot. \n".encode("latin-1"))
    (tmp_path / "in" / "b_fr.txt").write_bytes("﻿one\ntwo".encode())
    (tmp_path / "in" / "c.txt").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\nsubtitles under another name\n")
    assert main(["translate", str(tmp_path / "in"), str(tmp_path / "out"), "--code", "FR"]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_FR.txt", "b_FR.txt", "c_FR.srt", "c_FR.txt"]
    assert read(tmp_path / "out" / "a_FR.txt") == "Der Töpfer schlief.\nDas Boot." and read(tmp_path / "out" / "b_FR.txt") == "one\ntwo"


def test_run_in_one_command(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"ep{k}.json").write_text(json.dumps(words(f"We left pier {k} of course. It rained all day.")))
    (tmp_path / "pairs.csv").write_text("Of, course \n,x\n")
    assert main(["run", str(tmp_path / "in"), str(tmp_path / "out"), "--translate", "true", "--target", "German", "--pairs", str(tmp_path / "pairs.csv")]) == 0
    assert len(list((tmp_path / "out").glob("*.srt"))) == 6 and "We left pier 2" in read(tmp_path / "out" / "ep2_DE.txt")
    with pytest.raises(SystemExit):
        main(["run", str(tmp_path / "in"), str(tmp_path / "out"), "--segment", "no"])
    with pytest.raises(SystemExit):
        main(["run", str(tmp_path / "in"), str(tmp_path / "out"), "--mode", "flexible"])
    with pytest.raises(FileNotFoundError):
        main(["translate", str(tmp_path / "in"), str(tmp_path / "out")])


def test_settings_overlay(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"_": "a comment", "target_lang": "German", "target_lang_code": "DE", "glossary": ["a = b"], "drift_threshold": True, "space_between_cjk_and_latin": False, "extra": 1}))
    s = C.settings(str(path))
    assert (s.target_lang, s.target_lang_code, s.glossary, s.drift, s.spacing) == ("German", "DE", ["a = b"], 0.16, "false")
    assert C.settings(str(path), target_lang="Japanese").target_lang_code == "JP"
    assert C.settings(str(path), target_lang_code="fr").target_lang == "french"
    assert C.settings(str(path), target_lang="Klingon").target_lang_code == "DE"
    assert C.settings(str(tmp_path / "none.json")) == C.Settings() and C.Settings().drift is None
    for bad in ({"target_lang": "French", "target_lang_code": "DE"}, {"number_mode": "roman"}):
        with pytest.raises(ValueError):
            C.settings(None, **bad)
    with pytest.raises(TypeError):
        C.settings(None, colour="red")
    path.write_text("{not json")
    with pytest.warns(UserWarning):
        assert C.settings(str(path)) == C.Settings()


def test_services(tmp_path, monkeypatch):
    from cuewright.plans import exchange as X

    monkeypatch.delenv("ACME_API_KEY", raising=False)
    monkeypatch.delenv("API_BASE_URL", raising=False)
    path, env = tmp_path / "c.json", tmp_path / ".env"
    path.write_text(json.dumps({"services": {"acme": {"url": "http://localhost:1/v1/messages", "model": "m"}, "box": {"url": "http://localhost:2", "form": "im"}}}))
    env.write_text("# keys\nACME_API_KEY='secret'\nbroken\n")
    got = C.service(str(path), "acme", str(env))
    assert got == {"url": "http://localhost:1/v1/messages", "model": "m", "key": "secret", "form": "messages"}
    monkeypatch.setenv("ACME_API_KEY", "other")
    assert C.service(str(path), "acme", str(env))["key"] == "other" and C.service(str(path), "acme", url="http://x/v1/chat/completions")["form"] == "chat"
    made = X.backend(got)()
    assert isinstance(made, X.Http) and made.messages_form and "system" in made.body("s", "u", 5, 0.0)
    box = X.backend(C.service(str(path), "box"))()
    assert box.body("{user}", "u", 5, 0.0)["prompt"] == "<|im_start|>system\n{user}\n<|im_end|>\n<|im_start|>user\nu\n<|im_end|>\n<|im_start|>assistant\n"
    assert box.chat("s", "u", 1, 0.0) is None  # nobody listens
    assert [C.boolean(x) for x in ("Yes", "0", True)] == [True, False, True]
    with pytest.raises(ValueError):
        C.boolean("maybe")


def test_templates_and_flexible_timecodes(spark):
    from cuewright.functions.text import strip_ansi
    from cuewright.operators import translate as R
    from cuewright.plans import exchange as X

    df = spark.createDataFrame([("be brief", "hi \x1b[31mred\x1b[0m")], "s string, u string")
    for name in [*X.TEMPLATES, "unknown"]:
        got = df.select(X.chat_prompt("s", strip_ansi("u"), name).alias("p")).first().p
        assert got == X.TEMPLATES.get(name, X.TEMPLATES["tags"]).replace("{system}", "be brief").replace("{user}", "hi red")
    lines = spark.createDataFrame([("m", i, f"t{i}", f"00:00:0{i},000", f"00:00:0{i},500") for i in range(1, 6)], "media_id string, line_no int, text string, tc_start string, tc_end string")
    prompts = {r.win: r.user for r in R.user_prompts(R.window_lines(lines, ["media_id"], "flexible"), ["media_id"]).collect()}
    assert "[1] [00:00:01,000 --> 00:00:01,500] t1" in prompts[0] and "After:\n[00:00:05,000 --> 00:00:05,500] t5" in prompts[0]
    assert "-->" not in R.user_prompts(R.window_lines(lines, ["media_id"]), ["media_id"]).first().user
