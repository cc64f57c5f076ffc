"""Schemas of the engine's tables, as DDL.  Times are seconds from the start of the recording."""

FRAMES = "meeting_id string, frame_idx int, samples array<float>, is_tail boolean"
WINDOWS = "meeting_id string, pass string, ci int, start_s double, end_s double"
TAGGED = "meeting_id string, pass string, ci int, decoded string, duration double"
SEGMENT = "struct<start:double,end:double,text:string,speaker_idx:int>"
LOCAL_SEGMENTS = "meeting_id string, pass string, ci int, lspk int, spk_ord int, seg_ord int, start double, end double, text string"
NODES = "meeting_id string, pass string, ci int, lspk int, spk_ord int, total_dur double, is_clean boolean, window_s double, spine_emb array<double>, concat_emb array<double>"
IDENTITIES = "meeting_id string, ci int, lspk int, gid int, in_spine boolean, attribution string, mode string"
SEGMENTS = "meeting_id string, seg_idx int, speaker string, start double, end double, text string"
WORD = "struct<text:string,start:double,end:double,node:string,speaker:string,score:double,timing:string>"
REF_UTTERANCES = "meeting_id string, ord int, speaker_id string, begin_time double, end_time double, text string"
SPANS = "meeting_id string, start double, end double"
UTTERANCES_JSON = "array<struct<speaker_id:string,speaker:string,begin_time:double,start:double,start_time:double,end_time:double,end:double,text:string>>"
