"""Plans: experiments and registered queries."""
