"""prosarium: speech-prosody analytics and corpus preparation on Spark."""
