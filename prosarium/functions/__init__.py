"""Column functions: text, SSML, prosody arithmetic and metrics. All run inside the JVM unless said."""
