"""Schemas of the files that the library reads and writes."""

WORD = "struct<word:string,start:double,end:double,probability:double>"
SEGMENT = f"struct<id:int,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double,words:array<{WORD}>,language:string,language_probability:double,alignment_failed:boolean,speaker_id:string>"
EVENT = "struct<label:string,start:double,end:double,score:double,prompt_relevant:boolean>"
SPEAKER = "struct<id:string,speech_seconds:double,segment_count:int,embedding:array<double>>"
STATS = "struct<vad_regions:int,segments_kept:int,rejected_non_target_language:int,rejected_quality:int,rejected_empty:int,rejected_too_short:int,rejected_alignment_failed:int,marked_alignment_failed:int,detected_languages:map<string,int>,kept_speech_duration_sec:double>"
TRANSCRIPT = f"video_id string, source_audio string, language string, duration_sec double, segments array<{SEGMENT}>, transcribed_at string, aligned_at string, stats {STATS}, sound_events array<{EVENT}>, speakers array<{SPEAKER}>"
CLIP = "clip_id string, video_id string, start double, end double, text string, duration double, source_audio string, speaker_name string, avg_word_score double, avg_logprob double, no_speech_prob double, compression_ratio double, low_score_word_ratio double, mean_volume_db double, max_volume_db double, quality_score double"
VIDEO = "video_id string, title string, url string, duration_sec double, audio_path string, downloaded_at string"
METADATA = ("audio_file", "text", "speaker_name")
PAYLOAD = "language string, duration double, alignment_applied boolean, aligned_at string, speakers array<struct<id:string,speech_seconds:double,segment_count:int,embedding:array<double>>>, segments array<struct<kind:string,label:string,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double,language:string,speaker_id:string,score:double,prompt_relevant:boolean,alignment_failed:boolean,words:array<struct<word:string,start:double,end:double,probability:double,score:double>>>>"
