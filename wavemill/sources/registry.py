"""Benchmarks by name: where they come from, how their transcripts are prepared, how they are scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

JUDGES = ("llama3_70b_judge", "gpt4o_judge")
MORE_JUDGES = ("llama3_70b_judge", "llama3_70b_judge_binary", "llama3_8b_judge", "prometheus2_judge", "gpt4o_judge", "gpt4o_judge_binary")

# Benchmark names by task.
NAMES = {
    "SQA": [
        "cn_college_listen_mcq_test", "slue_p2_sqa5_test", "public_sg_speech_qa_test", "dream_tts_mcq_test", "spoken_squad_test",
        "imda_part3_30s_sqa_human_test", "imda_part4_30s_sqa_human_test", "imda_part5_30s_sqa_human_test", "imda_part6_30s_sqa_human_test",
        "ytb_sqa_batch1",
    ],
    "ASR": [
        "librispeech_test_clean", "librispeech_test_other", "common_voice_15_en_test", "peoples_speech_test", "gigaspeech_test", "earnings21_test",
        "earnings22_test", "tedlium3_test", "tedlium3_long_form_test", "imda_part1_asr_test", "imda_part2_asr_test", "imda_part3_30s_asr_test",
        "imda_part4_30s_asr_test", "imda_part5_30s_asr_test", "imda_part6_30s_asr_test", "seame_dev_man", "seame_dev_sge", "gigaspeech2_thai",
        "gigaspeech2_indo", "gigaspeech2_viet", "ytb_asr_batch1", "ytb_asr_batch2", "cna_test", "idpc_test", "parliament_test", "ukusnews_test",
        "mediacorp_test", "idpc_short_test", "parliament_short_test", "ukusnews_short_test", "mediacorp_short_test",
    ],
    "ASR-ZH": [
        "aishell_asr_zh_test",
    ],
    "SI": [
        "openhermes_audio_test", "alpaca_audio_test",
    ],
    "AC": [
        "audiocaps_test", "wavcaps_test",
    ],
    "ASQA": [
        "clotho_aqa_test", "audiocaps_qa_test", "wavcaps_qa_test",
    ],
    "AR": [
        "voxceleb_accent_test", "imda_ar_sentence", "imda_ar_dialogue",
    ],
    "GR": [
        "voxceleb_gender_test", "iemocap_gender_test", "imda_gr_sentence", "imda_gr_dialogue",
    ],
    "ER": [
        "iemocap_emotion_test", "meld_sentiment_test", "meld_emotion_test",
    ],
    "ST": [
        "covost2_en_id_test", "covost2_en_zh_test", "covost2_en_ta_test", "covost2_id_en_test", "covost2_zh_en_test", "covost2_ta_en_test",
    ],
    "SDS": [
        "imda_part3_30s_ds_human_test", "imda_part4_30s_ds_human_test", "imda_part5_30s_ds_human_test", "imda_part6_30s_ds_human_test",
        "ytb_sds_batch1",
    ],
    "PQA": [
        "ytb_pqa_batch1",
    ],
    "Music-QA": [
        "muchomusic_test",
    ],
    "Audio-Understanding-Reasoning": [
        "mmau_mini",
    ],
}
PREPARATION = {"aishell_asr_zh_test": "asr_zh", "seame_dev_man": "asr_zh", "seame_dev_sge": "asr_zh", "imda_part4_30s_asr_test": "asr_mixed", "gigaspeech2_thai": "thai", "gigaspeech2_viet": "vietnamese"}


@dataclass(frozen=True)
class Benchmark:
    name: str
    task: str
    metrics: tuple[str, ...]
    preparation: str

    def load(self, spark: SparkSession, root: str) -> DataFrame:
        """The benchmark as Parquet under root."""
        return spark.read.parquet(f"{root.rstrip('/')}/{self.name}")


def _metrics(name: str, task: str) -> tuple[str, ...]:
    if task.startswith("ASR"):
        return ("wer",)
    if task == "ST":
        return ("bleu",)
    if task == "AC":
        return (*JUDGES, "meteor")
    if name == "mmau_mini":
        return ("llama3_70b_judge", "string_match", "gpt4o_judge")
    return MORE_JUDGES if name.startswith("ytb_") else JUDGES


BENCHMARKS = {n: Benchmark(n, t, _metrics(n, t), PREPARATION.get(n, "asr" if t.startswith("ASR") else "raw")) for t, names in NAMES.items() for n in names}


def limited(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n samples by hash; all of them for n < 0."""
    from ..operators.rows import sample_exact

    return df if n < 0 else sample_exact(df, key, n, seed)
