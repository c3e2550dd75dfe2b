"""Schemas of the tables that are read with explicit types."""

from __future__ import annotations

SEGMENTS = "PhraseID string, Start double, End double, Duration double, Text string"
SYNTAGMES = (
    "syntagme string, begin_syntagme_synthesized double, end_syntagme_synthesized double, duration_syntagme_synthesized double, begin_syntagme_natural double, end_syntagme_natural double, duration_syntagme_natural double, "
    "duration_pause_syntagme_synthesized double, duration_pause_syntagme_natural double, natural_syntagme_audio_path string, synthesized_syntagme_audio_path string, natural_pitch_syntagme double, synthesized_pitch_syntagme double, is_pause boolean"
)
SSML_SEGMENTS = "segment string, syntagme string, ssml string"
TRANSCRIPT = "text string, language string, segments array<struct<id:int,start:double,end:double,text:string,words:array<struct<start:double,end:double,text:string,confidence:double>>>>"
ELEMENT = "struct<segment:string,type:string,text:string,time:string,prosody:struct<pitch:string,rate:string,volume:string>>"
CORPUS = f"map<string,struct<x:string,y:struct<parsed_sequence:array<{ELEMENT}>,stripped_ssml:map<string,array<string>>,raw_ssml:map<string,array<string>>>>>"
