"""DataFrame -> DataFrame operators (cleaning, summaries, mixture, survey, draws)."""
